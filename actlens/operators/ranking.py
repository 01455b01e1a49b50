"""Ranks and orders without a single-partition sort.

Two orders are served:

* a *hashed* order of unique keys (shuffles, splits, batches). The top hex
  digits of the hash cut the rows into equal buckets; a bucket's offset comes
  from one small count table.
* the order of an *integer*, or of a value as such (running sums, average ranks): sums
  over chunks, and over chunks of chunks. Rows at given ranks are in ``selection``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.functions.hashing import HASH_BITS, key_hash
from actlens.operators.selection import ordered_bits
from actlens.session import materialize


def hash_bucket(hashed: Column, digits: int) -> Column:
    """Leading ``digits`` hex digits of a 60-bit hash."""
    if digits == 0:
        return F.lit(0)
    return F.shiftright(hashed, HASH_BITS - 4 * digits).cast("int")


def bucket_offsets(counts: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Rows before each bucket, from a table of at most 16**digits rows per group."""
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(w)
    )


def global_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    salt: str = "",
    digits: int = 3,
    out: str = "rank",
    group: Sequence[str] = (),
    keep: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """0-based rank of each row in hashed order of its unique ``keys``.

    One exchange of ``df``, on the hash bucket. Pass key columns only and join
    wide columns back, unless the wide rows have to move anyway. ``keep`` says,
    from the first rank and the row count of a bucket, whether the bucket is
    wanted; rows of other buckets are dropped before the exchange.
    """
    hashed = df.withColumn("_h", key_hash(seed, salt, *[F.col(k) for k in [*group, *keys]]))
    hashed = hashed.withColumn("_b", hash_bucket(F.col("_h"), digits))
    counts = hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # 16**digits rows per group: broadcast for one group, where that is all. With groups the
    # planner joins by the partitioning that the ranks need anyway.
    offsets = bucket_offsets(counts, group, "_b")
    if keep is not None:
        offsets = offsets.where(keep(F.col("_off"), F.col("_n")))
    offsets = offsets.drop("_n", "_total")
    inside = W.partitionBy(*group, "_b").orderBy("_h", *keys)
    return (
        hashed.join(offsets if group else F.broadcast(offsets), [*group, "_b"])
        .withColumn("_r", F.row_number().over(inside))
        .withColumn(out, F.col("_off") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_off")
    )


def hash_order_key(df: DataFrame, keys: Sequence[str], seed: int, salt: str = "") -> Column:
    """Struct that sorts rows in the order of :func:`global_rank`."""
    return F.struct(
        key_hash(seed, salt, *[F.col(k) for k in keys]).alias("_h"), *[F.col(k) for k in keys]
    )


def rank_cuts(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    ranks: Sequence[Callable[[Column], Column]],
    salt: str = "",
    digits: int = 3,
) -> DataFrame:
    """One row: ``n`` and, for each rank asked for, the order key ``cut_i`` at that rank.

    ``ranks`` are functions of ``n``; a rank of ``n`` or more gives NULL. Only
    the few hash buckets that hold a cut are sorted. Comparing a row's order key
    with a cut then replaces a join of every row with its rank.
    """
    order = hash_order_key(df, keys, seed, salt)
    keyed = df.select(*keys, order.alias("_key"))
    keyed = keyed.withColumn("_b", hash_bucket(F.col("_key._h"), digits))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = bucket_offsets(counts, (), "_b")
    asked = F.array(
        *[F.struct(F.lit(i).alias("i"), r(F.col("_total")).alias("rank")) for i, r in enumerate(ranks)]
    )
    targets = (
        offsets.select("_b", "_n", "_off", F.explode(asked).alias("_t"))
        .where((F.col("_t.rank") >= F.col("_off")) & (F.col("_t.rank") < F.col("_off") + F.col("_n")))
        .select("_b", F.col("_t.i").alias("_i"), (F.col("_t.rank") - F.col("_off")).alias("_k"))
    )
    inside = W.partitionBy("_i", "_b").orderBy("_key")
    picks = (
        keyed.join(F.broadcast(targets), "_b")  # one row per cut
        .withColumn("_r", F.row_number().over(inside) - 1)
        .where(F.col("_r") == F.col("_k"))
        .agg(
            *[
                F.max(F.when(F.col("_i") == i, F.col("_key"))).alias(f"cut_{i}")
                for i in range(len(ranks))
            ]
        )
    )
    return picks.withColumn("n", counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar())


def before_cut(order_key: Column, cut: Column) -> Column:
    """True where a row sorts before ``cut`` (a NULL cut lies past the last row)."""
    return cut.isNull() | (order_key < cut)


def rank_between(
    df: DataFrame, keys: Sequence[str], seed: int, start: int, stop: int, salt: str = ""
) -> DataFrame:
    """Rows whose hashed rank lies in ``[start, stop)``; ``df`` itself is not shuffled."""
    if not 0 <= start <= stop:
        raise ValueError(f"bad range [{start}:{stop}]")
    cuts = rank_cuts(df.select(*keys), keys, seed, [lambda n: F.lit(start), lambda n: F.lit(stop)], salt)
    cut = cuts.select(F.struct("cut_0", "cut_1")).scalar()
    key = hash_order_key(df, keys, seed, salt)
    return df.where(~before_cut(key, cut["cut_0"]) & before_cut(key, cut["cut_1"]))


# --- running sums and ranks in an integer order -------------------------------------

# Bits of the order that are one window: chunks of rows, chunks of chunks, and so on.
CHUNK_BITS = 16


def running_sum(
    df: DataFrame, by: Sequence[str], order: str, value: Column, out: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group (exclusive).

    ``order`` is a BIGINT that is unique in the group. Its bits cut the group into chunks,
    the chunks into chunks of chunks, up to one root. Sums are added upwards, combined
    in the map tasks, and offsets are handed down, so that no task orders more than
    2 ** ``bits`` rows or sums of one group, however sparse the integers are.
    """
    by = list(by)
    levels = -(-64 // bits)

    def chunk(level: int) -> str:
        return f"_c{level}"

    def exclusive(level: int, of: str, order_by: str) -> Column:
        w = W.partitionBy(*by, chunk(level)).orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(of).over(w), F.lit(0))

    cut = df.withColumns({"_v": value, "_o": F.col(order).cast("bigint")})
    cut = cut.withColumn(chunk(1), F.shiftright("_o", bits))
    sums = {1: cut.groupBy(*by, chunk(1)).agg(F.sum("_v").alias("_n"))}
    for level in range(2, levels):
        above = sums[level - 1].withColumn(chunk(level), F.shiftright(chunk(level - 1), bits))
        sums[level] = above.groupBy(*by, chunk(level)).agg(F.sum("_n").alias("_n"))
    offsets = sums[levels - 1].withColumn(chunk(levels), F.lit(0))
    offsets = offsets.withColumn("_off", exclusive(levels, "_n", chunk(levels - 1))).drop("_n", chunk(levels))
    for level in range(levels - 2, 0, -1):
        inner = sums[level].withColumn(chunk(level + 1), F.shiftright(chunk(level), bits))
        inner = inner.withColumn("_in", exclusive(level + 1, "_n", chunk(level)))
        offsets = inner.join(offsets, [*by, chunk(level + 1)])
        offsets = offsets.select(*by, chunk(level), (F.col("_off") + F.col("_in")).alias("_off"))
    return (
        cut.withColumn("_s", exclusive(1, "_v", "_o"))
        .join(offsets, [*by, chunk(1)])
        .withColumn(out, F.col("_off") + F.col("_s"))
        .drop("_v", "_o", "_s", "_off", chunk(1))
    )


def average_rank(tallies: DataFrame, by: Sequence[str], value: str, count: str, out: str) -> DataFrame:
    """``by``, ``value`` and the 1-based rank of that value, ties sharing their average.

    ``tallies`` has ``count`` rows for each of some values; values may repeat.
    """
    totals = tallies.groupBy(*by, value).agg(F.sum(count).alias("_c"))
    ordered = materialize(totals.withColumn("_bits", ordered_bits(F.col(value))), "tallies")
    before = running_sum(ordered, by, "_bits", F.col("_c"), "_before")
    return before.select(*by, value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
