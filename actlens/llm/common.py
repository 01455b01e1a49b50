"""What the operators share: settings, row packing, and ranks over a sorted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.session import materialize, prepare

# A word: the bytes between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Texts may be very long; a Python batch holds at most this many of them.
BATCH_ROWS = "512"


def session(spark: SparkSession) -> SparkSession:
    """Settings of the package, with small Arrow batches for long texts."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the width that the cluster was given."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, so that no helper column can clash."""
    return docs.select(F.struct("*").alias("row"))


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case.

    ``lower`` says the same of an ASCII text, in a byte loop.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ordered_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows sorted by ``order`` over all partitions, with ``part`` and the 0-based rank ``index``.

    Sampled splitters deal the rows into ordered partitions, which are sorted and
    written once. A row's place inside its partition comes from the row counter of
    the task, so only one count per partition has to be summed: no global window.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        name,
    ).withColumn("part", F.shiftright("_place", 33))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: as many as the session's shuffle partitions at most.
    offsets = counts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("index", F.col("_off") + inside)
        .drop("_place", "_off")
    )
