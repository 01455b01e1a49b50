"""Balanced contiguous shards from global prefix sums of byte sizes.

Narrow rows are sorted by (digest of the text, id) over all partitions. Byte
totals per partition are summed to offsets; only the partitions that hold one of
the equal targets are summed row by row, and the rows at the targets become
cuts. A row's shard is the number of cuts at or before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.llm.common import ordered_index, packed, whole

# Bytes that a record needs besides its text.
RECORD = 8
# Equal texts with up to this part of a shard's bytes stay together.
TOGETHER = 1 / 64


def balanced_shards(
    docs: DataFrame, shards: int = 24, text: str = "text", id: str = "doc_id", together: float = TOGETHER
) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, … inside the shard) per row.

    A shard's bytes differ from an equal share by half a row at each cut, or by half
    a group of equal texts if the group has at most ``together`` of a share: such a
    group is moved to the side that holds more of it. Larger groups are cut by id.

    * A null text has no bytes and the checksum of the empty text.
    * Null ids sort first; repeated rows take neighbouring slots.
    * A row larger than a share leaves shards empty; an empty table gives no rows.
    * Other columns are not read.
    """
    body = whole(F.col(f"row.{text}"))
    narrow = packed(docs).select(
        F.md5(body).alias("digest"),
        F.col(f"row.{id}").alias("id"),
        (F.octet_length(body) + F.lit(RECORD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = ordered_index(narrow, ["digest", "id"], "shard-rows")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.max("index").alias("last"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One row per partition.
    spans = totals.withColumn("from", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn(
        "all", F.sum("bytes").over(every)
    )
    goals = spans.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))) if shards > 1 else (
        spans.withColumn("cut", F.lit(0)).limit(0)
    )
    goals = goals.withColumn("goal", F.col("all") * F.col("cut") / shards).where(
        (F.col("goal") > F.col("from")) & (F.col("goal") <= F.col("from") + F.col("bytes"))
    )
    running = W.partitionBy("part", "cut").orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("from") + F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("size") / 2.0
    # At most shards - 1 rows: each goal lies in one partition.
    cuts = (
        rows.join(F.broadcast(goals), "part")
        .withColumn("middle", middle)
        .groupBy("cut", "last", "all")
        .agg(F.min(F.when(F.col("middle") >= F.col("goal"), F.col("index"))).alias("at"))
        .select("cut", "all", F.coalesce("at", F.col("last") + 1).alias("at"))
    )
    # The groups of equal texts at the cuts.
    inside = rows.join(F.broadcast(cuts), rows["index"] == cuts["at"]).select("cut", "at", "all", "digest")
    groups = (
        rows.join(F.broadcast(inside), "digest")
        .groupBy("cut", "at", "all")
        .agg(
            F.min("index").alias("first"),
            (F.max("index") + 1).alias("end"),
            F.sum("size").alias("bytes"),
            F.sum(F.when(F.col("index") < F.col("at"), F.col("size")).otherwise(0)).alias("left"),
        )
        .withColumn("small", F.col("bytes") <= F.col("all") * together / shards)
        .withColumn("near", F.when(F.col("left") * 2 > F.col("bytes"), F.col("end")).otherwise(F.col("first")))
        .select("cut", F.when(F.col("small"), F.col("near")).otherwise(F.col("at")).alias("moved"))
    )
    final = (
        cuts.join(groups, "cut", "left")
        .agg(F.sort_array(F.collect_list(F.coalesce("moved", "at"))).alias("cuts"))  # shards - 1 numbers
    )
    behind = F.filter("cuts", lambda c: c <= F.col("index"))
    return (
        rows.crossJoin(F.broadcast(final))  # one row
        .withColumn("behind", behind)
        .withColumn("shard", F.size("behind"))
        .withColumn("slot", F.col("index") - F.coalesce(F.array_max("behind"), F.lit(0)))
        .select("id", "size", "text_crc32", "shard", "slot")
    )
