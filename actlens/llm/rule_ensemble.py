"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded labelled sample; every path from the
root becomes a conjunctive rule. A lasso logistic regression keeps few of the
rules, and these are compiled into one Spark column expression, so that scoring
a corpus needs no model object and no Python beyond the statistics.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import packed
from actlens.llm.text_stats import STATS, text_stats
from actlens.session import materialize

# The only bound on what the classifier learns from: this many labelled rows, drawn
# by a hash of the id.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` (``below``) or ``feature > threshold``."""

    feature: int
    threshold: float
    below: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        under = x[:, self.feature] <= self.threshold
        return under if self.below else ~under


@dataclass
class RuleModel:
    """A constant plus a weight per rule; the score is the logistic function of the sum."""

    constant: float
    rules: list[tuple[tuple[Condition, ...], float]]
    features: tuple[str, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for conditions, weight in self.rules:
            total += weight * np.logical_and.reduce([c.holds(x) for c in conditions])
        return 1 / (1 + np.exp(-total))

    def column(self, stats: str) -> Column:
        """The score as an expression over the struct column ``stats``.

        The rules are one constant array that is folded when the query is planned, so the
        expression has the same few nodes for any number of rules; a sum with a CASE per
        rule outgrows the 64 KB of a generated method.
        """
        if not self.rules:
            return F.lit(1.0 / (1.0 + math.exp(-self.constant)))
        rules = ", ".join(
            f"struct({weight!r}D AS weight, array({', '.join(map(_condition_sql, conditions))}) AS conditions)"
            for conditions, weight in ((c, float(w)) for c, w in self.rules)
        )
        values = ", ".join(f"{stats}.{name}" for name in self.features)
        # The values are bound to a name first, or they would be gathered again for every condition.
        total = F.expr(
            f"transform(array(array({values})), v -> aggregate(array({rules}), {float(self.constant)!r}D, (total, rule) -> "
            "total + IF(forall(rule.conditions, c -> (v[c.feature] <= c.threshold) = c.below), rule.weight, 0D)))[0]"
        )
        return 1.0 / (1.0 + F.exp(-total))


def _condition_sql(c: Condition) -> str:
    return f"struct({int(c.feature)} AS feature, {float(c.threshold)!r}D AS threshold, {str(bool(c.below)).lower()} AS below)"


def tree_paths(
    x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], pull: np.ndarray, depth: int, least: int
) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Grow one regression tree on ``pull``; its paths, and the fitted value of every row."""
    bins = max(len(e) for e in edges) + 1
    fitted = np.zeros(len(x))
    paths: list[tuple[Condition, ...]] = []
    open_nodes = [((), np.arange(len(x)))]
    while open_nodes:
        path, rows = open_nodes.pop()
        fitted[rows] = pull[rows].mean()
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-9, -1, -1)
        all_sum, all_n = pull[rows].sum(), len(rows)
        for f in range(x.shape[1]):
            codes = binned[rows, f]
            sums = np.cumsum(np.bincount(codes, pull[rows], bins))[:-1]
            counts = np.cumsum(np.bincount(codes, minlength=bins))[:-1]
            fits = (counts >= least) & (all_n - counts >= least)
            if not fits.any():
                continue
            left = sums**2 / np.maximum(counts, 1)
            right = (all_sum - sums) ** 2 / np.maximum(all_n - counts, 1)
            gain = np.where(fits, left + right - all_sum**2 / all_n, -1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        _, f, at = best
        if f < 0:
            continue
        under = binned[rows, f] <= at
        threshold = float(edges[f][at])
        open_nodes.append(((*path, Condition(f, threshold, True)), rows[under]))
        open_nodes.append(((*path, Condition(f, threshold, False)), rows[~under]))
    return paths, fitted


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Constant and weights that minimise mean log loss + penalty * |weights|, by accelerated proximal steps."""
    n, k = a.shape
    with_one = np.ones((n, k + 1), np.float32)  # the only large array
    with_one[:, 1:] = a
    step = 4 * n / max(np.linalg.norm((with_one.T @ with_one).astype(float), 2), 1e-9)
    w = np.zeros(k + 1)
    rate = (y.sum() + 1) / (n + 2)
    w[0] = np.log(rate / (1 - rate))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(with_one @ ahead.astype(np.float32)).astype(float))) - y
        new = ahead - step * (with_one.T @ error.astype(np.float32)).astype(float) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(
    x: np.ndarray,
    y: np.ndarray,
    features: tuple[str, ...] = STATS,
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    penalty: float = 2e-4,
    steps: int = 500,
    seed: int = 42,
) -> RuleModel:
    """A rule model of labels ``y`` (0 or 1). Without both labels it is the constant rate."""
    y = np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(start, [], tuple(features))
    rng = np.random.default_rng(seed)
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], cuts)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    least = max(5, len(y) // 400)
    margin, found = np.full(len(y), start), {}
    for _ in range(trees):
        drawn = rng.random(len(y)) < 0.5
        pull = y - 1 / (1 + np.exp(-margin))
        if drawn.sum() < 2 * least:
            drawn[:] = True
        paths, _ = tree_paths(x[drawn], binned[drawn], edges, pull[drawn], depth, least)
        # Newton steps of the leaves over all rows, so that the next tree sees what is left.
        step = np.zeros(len(y))
        for path in paths:
            rows = np.logical_and.reduce([c.holds(x) for c in path])
            found.setdefault(hashlib.sha1(rows.tobytes()).digest(), (path, rows))
            if len(path) == depth:
                p = 1 / (1 + np.exp(-margin[rows]))
                step[rows] = pull[rows].sum() / max((p * (1 - p)).sum(), 1e-3)
        margin += rate * np.clip(step, -4, 4)
    kept = [(path, rows) for path, rows in found.values() if least <= rows.sum() <= len(y) - least]
    if not kept:
        return RuleModel(start, [], tuple(features))
    constant, weights = lasso_logistic(np.column_stack([rows for _, rows in kept]), y, penalty, steps)
    rules = [(path, float(w)) for (path, _), w in zip(kept, weights) if w != 0]
    return RuleModel(constant, rules, tuple(features))


def is_held_out(id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 3 == 1


def learn(scored: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS, **options) -> RuleModel:
    """Fit on rows (``id``, ``stats``) that have a label and are not held out, ``sample_rows`` of them at most."""
    marks = packed(labels).select(F.col(f"row.{id}").alias("id"), F.col(f"row.{label}").cast("double").alias("label"))
    rows = (
        scored.where(~is_held_out(F.col("id")))
        .join(marks.where("label IN (0, 1)"), "id")
        .select("stats.*", "label", F.xxhash64("id").alias("draw"), "id")
        .orderBy("draw", "id")
        .limit(sample_rows)
        .drop("draw", "id")
        .toArrow()
    )
    columns = [rows.column(name).to_numpy() for name in (*STATS, "label")]
    return fit_rules(np.column_stack(columns[:-1]), columns[-1], **options)


def with_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``row`` (all columns), ``held_out``, ``score`` and ``predicted`` for every row.

    The classifier learns from labelled rows that are not held out and scores all
    rows by statistics of the whole text alone.

    * A null text counts as empty; its statistics are zero, and it gets a score.
    * Rows with a null id are scored but never learnt from; repeated rows are rows like others.
    * Labels other than 0 and 1 are not used; without both labels every score is the (smoothed) rate.
    * An empty table gives an empty result.
    """
    rows = packed(docs)
    stats = rows.select(F.col(f"row.{id}").alias("id"), text_stats(F.col(f"row.{text}")).alias("stats"))
    marked = packed(labels).select(F.col(f"row.{id}").alias("id")).distinct()
    # Statistics of labelled rows only are stored for learning.
    model = learn(stats.join(marked, "id", "left_semi"), labels, id=id, **options)
    return apply_rules(rows, model, text, id)


def apply_rules(rows: DataFrame, model: RuleModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Score rows packed by :func:`actlens.llm.common.packed`."""
    return (
        rows.withColumn("stats", text_stats(F.col(f"row.{text}")))
        .withColumn("held_out", is_held_out(F.col(f"row.{id}")))
        .withColumn("score", model.column("stats"))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
        .drop("stats")
    )


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted``: like :func:`with_quality`, without the texts.

    The statistics are computed once and stored; learning and scoring read them.
    """
    stats = materialize(
        packed(docs).select(F.col(f"row.{id}").alias("id"), text_stats(F.col(f"row.{text}")).alias("stats")), "text-stats"
    )
    model = learn(stats, labels, id=id, **options)
    return (
        stats.withColumn("held_out", is_held_out(F.col("id")))
        .withColumn("score", model.column("stats"))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
        .drop("stats")
    )
