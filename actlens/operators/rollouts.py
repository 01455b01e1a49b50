"""Scored samples: advantages, picks, summaries and mismatch metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.functions import text
from actlens.operators.aggregates import PERCENTILES
from actlens.operators.ranking import average_rank
from actlens.operators.selection import exact_percentiles, rows_at_ranks
from actlens.session import materialize


def group_advantage(
    df: DataFrame, by: Sequence[str] = ("rollout_id", "group_index"), eps: float = 1e-6
) -> DataFrame:
    """Reward relative to its prompt group: (reward - mean) / (population std + eps).

    Group figures are aggregated map-side and joined back, so a hot group is
    never collected into one window.
    """
    figures = df.groupBy(*by).agg(
        F.avg("reward").alias("group_mean"), F.stddev_pop("reward").alias("group_std")
    )
    return df.join(figures, list(by)).withColumn(
        "advantage", (F.col("reward") - F.col("group_mean")) / (F.col("group_std") + F.lit(eps))
    )


def _interval(tag: int, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), lo.alias("lo"), hi.alias("hi"))


def best_mid_worst(
    df: DataFrame,
    top: int = 6,
    mid: int = 8,
    bottom: int = 6,
    by: Sequence[str] = ("rollout_id",),
    tie: str = "sample_id",
) -> DataFrame:
    """Best, middle and worst samples by reward, each once, numbered in ``pick``.

    ``rank`` is the 0-based place by reward, ties broken by the integer ``tie``; NULL
    rewards take no place. ``bottom = 0`` picks none from the end.
    """

    def wanted(n: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        mid_lo = F.greatest(zero, F.floor(n / 2) - F.lit(mid // 2))
        return F.array(
            _interval(0, zero, zero + top),
            _interval(1, mid_lo, mid_lo + mid),
            _interval(2, F.greatest(zero, n - bottom), n),
        )

    ranked = rows_at_ranks(df, by, -F.col("reward"), tie, wanted)
    return picks_union(ranked, by)


def picks_union(picks: DataFrame, by: Sequence[str] = ("rollout_id",)) -> DataFrame:
    """Union of picks (``tag`` = list number, ``rank``): the first occurrence stays.

    Works on the picked rows only, at most top + mid + bottom per group.
    """
    first = W.partitionBy(*by, "rank").orderBy("tag")
    order = W.partitionBy(*by).orderBy("tag", "rank")
    return (
        picks.withColumn("_seen", F.row_number().over(first))
        .where(F.col("_seen") == 1)
        .drop("_seen")
        .withColumn("pick", F.row_number().over(order))
    )


def rollout_summary(df: DataFrame, by: Sequence[str] = ("rollout_id",)) -> DataFrame:
    """Size, groups and reward figures per rollout; percentiles are linear-interpolated."""
    plain = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("group_index").alias("groups"),
        F.avg("reward").alias("mean"),
        F.stddev_pop("reward").alias("std"),
        F.min("reward").alias("min"),
        F.max("reward").alias("max"),
    )
    plain = plain.withColumn("per_group", F.floor(F.col("n") / F.col("groups")))
    return plain.join(exact_percentiles(df, by, "reward", PERCENTILES), list(by))


def mismatch_metrics(
    df: DataFrame,
    train: str = "train_log_probs",
    rollout: str = "rollout_log_probs",
    by: Sequence[str] = ("rollout_id",),
) -> DataFrame:
    """Token-level ratio of the two policies: mean ratio, mean |ratio - 1| and mean k3.

    A sample whose two arrays differ in length is an error: its tokens do not belong together.
    """
    pairs = F.arrays_zip(F.col(train), F.col(rollout))
    lengths = F.concat(F.size(train).cast("string"), F.lit(" and "), F.size(rollout).cast("string"))
    unequal = F.raise_error(F.concat(F.lit("log-probabilities of unequal length: "), lengths))
    checked = F.when(F.size(train) == F.size(rollout), pairs).when(pairs.isNull(), pairs)
    checked = checked.otherwise(unequal.cast(df.select(pairs.alias("p")).schema["p"].dataType))
    tokens = df.select(*by, F.explode(checked).alias("t"))
    log_ratio = F.col(f"t.{train}") - F.col(f"t.{rollout}")
    ratio = F.exp(log_ratio)
    return tokens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.avg(ratio).alias("tis"),
        F.avg(F.abs(ratio - 1)).alias("tis_abs"),
        F.avg(ratio - 1 - log_ratio).alias("tis_k3"),
    )


def extraction_rate(
    df: DataFrame, by: Sequence[str] = ("rollout_id",), response: str = "response"
) -> DataFrame:
    """Share of responses with a well-formed explanation; 0 in a batch is an alarm."""
    found = text.extract_explanation(F.col(response)).isNotNull()
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(found).alias("extracted"),
            F.avg(found.cast("double")).alias("extraction_rate"),
        )
        .withColumn("none_extracted", F.col("extracted") == 0)
    )


def length_reward_corr(
    df: DataFrame,
    by: Sequence[str] = ("rollout_id",),
    length: str = "response_length",
    reward: str = "reward",
) -> DataFrame:
    """Linear and rank correlation of response length with reward, over rows that have both.

    Everything comes from counts of (length, reward), formed in the map tasks. Ranks with
    shared ties have the mean (n + 1) / 2, so the rank correlation is one weighted sum.
    """
    keys = list(by)
    both = F.col(length).isNotNull() & F.col(reward).isNotNull()
    rows = df.where(both).select(*keys, F.col(length).cast("double").alias("_l"), F.col(reward).cast("double").alias("_r"))
    tallies = materialize(rows.groupBy(*keys, "_l", "_r").agg(F.count(F.lit(1)).alias("_c")), "tallies")
    figures = tallies.groupBy(*keys).agg(
        F.sum("_c").alias("_n"),
        (F.sum(F.col("_c") * F.col("_l")) / F.sum("_c")).alias("_ml"),
        (F.sum(F.col("_c") * F.col("_r")) / F.sum("_c")).alias("_mr"),
    )
    ranked = (
        tallies.join(average_rank(tallies, keys, "_l", "_c", "_rank_l"), [*keys, "_l"])
        .join(average_rank(tallies, keys, "_r", "_c", "_rank_r"), [*keys, "_r"])
        .join(figures, keys)
    )
    mean_rank = (F.col("_n") + 1) / 2

    def correlation(x: Column, y: Column) -> Column:
        def total(z: Column) -> Column:
            return F.sum(F.col("_c") * z)

        spread = F.sqrt(total(x * x) * total(y * y))
        return F.try_divide(total(x * y), spread)

    return ranked.groupBy(*keys).agg(
        correlation(F.col("_l") - F.col("_ml"), F.col("_r") - F.col("_mr")).alias("pearson"),
        correlation(F.col("_rank_l") - mean_rank, F.col("_rank_r") - mean_rank).alias("spearman"),
    )


def rollout_report(df: DataFrame, max_chars: int = 1800, **picks) -> DataFrame:
    """Rows of the sample report: picks with label, clipped source and explanation."""
    chosen = best_mid_worst(df, **picks)
    out = chosen.withColumn("label", text.source_label(F.col("doc_id"))).withColumn(
        "explanation", text.explanation_body(F.col("response"))
    )
    if "detokenized_text_truncated" in df.columns:
        out = out.withColumn(
            "source_text", text.clip_note(F.col("detokenized_text_truncated"), max_chars)
        )
    return out
