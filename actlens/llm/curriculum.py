"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Every source has a target in words and a weight schedule over training time. The
integral of the schedule, scaled to the target, is the source's cumulative
demand; a document stands at the time at which the demand reaches the middle of
its words. Documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.functions.hashing import HASH_BITS, key_hash
from actlens.llm.common import WORD, ordered_index, packed, partitions, whole
from actlens.session import materialize

SEED = 42
WEIGHTS = (5.0, 2.0, 1.0)
# Weight schedules as (time, weight) knots, joined by straight lines; they repeat
# over the sources like the weights. Only their shape matters: the area is scaled
# to the source's target.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def words(text: Column) -> Column:
    """Number of words of the text (null: 0)."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to a table with one row per source (``size``, ``place``).

    The targets sum to ``share`` of all sizes, in proportion to the weights, except
    that a source gives ``most`` times its size at most; what it cannot give is
    shared by the others. The common level ``t`` with sum(min(most * size, t * weight))
    = total is found by Newton's method on one small aggregate per step: the level
    rises until no further source reaches its limit.
    """
    weighted = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    level, full = 0.0, -1
    while True:
        at_limit = F.col("weight") * level >= F.col("size") * most
        step = weighted.agg(
            (F.sum("size") * share).alias("total"),
            F.sum(F.when(at_limit, F.col("size") * most).otherwise(0.0)).alias("given"),
            F.sum(F.when(~at_limit, F.col("weight")).otherwise(0.0)).alias("open"),
            F.count(F.when(at_limit, 1)).alias("full"),
        ).first()
        if not step["open"] or step["full"] == full:
            break
        level, full = (step["total"] - step["given"]) / step["open"], step["full"]
    if sources.isEmpty() or not step["open"]:
        return weighted.withColumn("target", F.col("size") * most).drop("weight")
    return weighted.withColumn("target", F.least(F.col("size") * most, F.col("weight") * level)).drop("weight")


def when_reached(part: Column, place: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Time at which the integral of the source's schedule reaches ``part`` of its whole."""

    def inverse(knots: Sequence[tuple[float, float]]) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole_area, done = sum(areas), 0.0
        out = F.lit(float(knots[-1][0]))
        pieces = []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            need = part * whole_area - done
            slope = (w1 - w0) / (t1 - t0)
            # need = w0 * x + slope * x^2 / 2, solved without cancellation
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2 * slope), F.lit(0.0)))
            pieces.append((done + area, F.lit(t0) + need * 2 / (F.lit(w0) + root)))
            done += area
        for end, at in reversed(pieces):
            out = F.when(part * whole_area <= end, at).otherwise(out)
        return out

    kind = place % len(schedules)
    chosen = inverse(schedules[-1])
    for i, knots in reversed(list(enumerate(schedules[:-1]))):
        chosen = F.when(kind == i, inverse(knots)).otherwise(chosen)
    return chosen


def curriculum(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = SEED,
) -> DataFrame:
    """``id``, ``source``, ``text_hash``, ``size``, ``source_size``, ``target``, ``passes`` and ``times`` per row.

    ``passes`` says how often the mix takes the whole document and ``times`` when.
    Inside a source the documents follow a keyed hash of their id; copy ``k`` of the
    order starts where copy ``k - 1`` ends, and a document is taken while its middle
    lies below the target, so a source misses its target by half a document at most.

    * Sources are ranked by code point; null is a source of its own, ranked last.
    * A null text has no words; documents without words are never taken.
    * Repeated rows and null ids are rows like others (ties go by size).
    * An empty table gives an empty result. Other columns are not read.

    A source is cut into hash ranges, as many as the session has shuffle partitions;
    sums run inside a range, on narrow rows, so no source has to fit in one task.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    width = ((1 << HASH_BITS) + parts - 1) // parts
    row = packed(docs)
    rows = row.select(
        F.col(f"row.{id}").alias("id"),
        F.col(f"row.{source}").isNull().alias("no_source"),
        F.coalesce(F.col(f"row.{source}").cast("string"), F.lit("")).alias("source"),
        F.xxhash64(f"row.{text}").alias("text_hash"),
        words(F.col(f"row.{text}")).alias("size"),
    ).withColumn("draw", key_hash(seed, "mix", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("range", F.floor(F.col("draw") / width).cast("int")), "mix-rows")

    of_source, of_range = ["no_source", "source"], ["no_source", "source", "range"]
    ranges = rows.groupBy(*of_range).agg(F.sum("size").alias("words"))
    earlier = W.partitionBy(*of_source).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranges.groupBy(*of_source).agg(F.sum("words").alias("size"))
    placed = ordered_index(sizes, of_source, "mix-sources").withColumnRenamed("index", "place")
    goal = targets(placed, weights, share, float(most)).withColumnRenamed("size", "source_size").drop("part")
    starts = ranges.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(goal, of_source)

    inside = W.partitionBy(*of_range).orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    middles = F.array(*[F.col("start") + F.col("source_size") * k + F.col("size") / 2.0 for k in range(most)])
    return (
        rows.join(starts.drop("words"), of_range)
        .withColumn("start", start)
        .withColumn("taken_at", F.filter(middles, lambda m: (m < F.col("target")) & (F.col("size") > 0)))
        .withColumn("times", F.transform("taken_at", lambda m: when_reached(m / F.col("target"), F.col("place"), schedules)))
        .select(
            "id",
            F.when(~F.col("no_source"), F.col("source")).alias("source"),
            "text_hash",
            "size",
            "source_size",
            "target",
            F.size("times").alias("passes"),
            "times",
        )
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy (``time`` instead of ``passes`` and ``times``), range-sorted by time."""
    copies = mixed.withColumn("time", F.explode("times")).drop("times", "passes")
    return copies.orderBy("time", "id", "text_hash")


def mixed_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, a copy per pass, with the columns of ``docs``, in training order.

    Repeated rows (equal in id and text) all take the passes of one of them, the one with the least times.
    """
    plan = (
        curriculum(docs, text, id, **options)
        .where("passes > 0")
        .groupBy(F.col("id").alias("p_id"), F.col("text_hash").alias("p_hash"))
        .agg(F.min("times").alias("times"))
    )
    same = F.col(f"row.{id}").eqNullSafe(F.col("p_id")) & (F.xxhash64(f"row.{text}") == F.col("p_hash"))
    copies = packed(docs).join(plan, same).select("row", F.explode("times").alias("time"))
    return copies.orderBy("time", F.col(f"row.{id}")).select("row.*")
