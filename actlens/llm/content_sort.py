"""Exact duplicates by sorting contents: equal texts end up next to each other.

Sampled splitters deal the rows into ranges of the normalised text; each range is
sorted by the whole text, and a row starts a new group where it differs from its
neighbour in a full comparison. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.llm.common import ascii_lower, packed, partitions, whole

# Splitters are sampled to the driver, so ranges are cut on a bounded prefix and,
# among texts that share it, on the digest of the whole text.
PREFIX = 32


def content_sort(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``row`` (all columns), ``text_sha256``, ``keep_id``, ``group_size`` and ``kept`` for every row.

    Texts are equal when identical after lower-casing A-Z; the row with the largest
    id of a group is kept.

    * A null text counts as the empty text; empty texts form one group.
    * Rows with a null id sort last: one is kept only where a group has no other.
    * Among repeated rows with the largest id exactly one is kept.
    * An empty table gives an empty result; other columns pass through in ``row``.

    A group with more rows than a partition's even share is split by a hash of the
    id into runs of about that share. Fewer groups than partitions can be that large,
    so their sizes and kept ids, counted in the map tasks first, are broadcast.
    """
    parts = partitions(docs.sparkSession)
    body = ascii_lower(whole(F.col(f"row.{text}")))
    keyed = (
        packed(docs)
        .withColumn("id", F.col(f"row.{id}"))
        .withColumn("text_sha256", F.sha2(body, 256))
        .withColumn("prefix", ascii_lower(F.substring(whole(F.col(f"row.{text}")), 1, PREFIX)))
    )
    n_rows = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = (
        keyed.groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("hot_size"), F.max("id").alias("hot_keep"))
        .where(F.col("hot_size") * parts > n_rows)
    )
    salts = F.ceil(F.col("hot_size") * parts / n_rows)
    salted = keyed.join(F.broadcast(hot), "text_sha256", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), salts), F.lit(0))
    )
    ranges = salted.repartitionByRange("prefix", "text_sha256", "salt").withColumn("norm", body)
    # The ranges already hold each of these groups whole, so nothing moves again.
    run = W.partitionBy("prefix", "text_sha256", "salt", "norm")
    return (
        ranges.withColumn("place", F.row_number().over(run.orderBy(F.col("id").desc_nulls_last())))
        .withColumn("keep_id", F.coalesce("hot_keep", F.max("id").over(run)))
        .withColumn("group_size", F.coalesce("hot_size", F.count(F.lit(1)).over(run)))
        .withColumn("kept", (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id")))
        .select("row", "text_sha256", "keep_id", "group_size", "kept")
    )


def distinct_texts(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The kept rows of :func:`content_sort`, with the columns of ``docs``."""
    return content_sort(docs, text, id).where("kept").select("row.*")
