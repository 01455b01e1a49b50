"""Shuffles, epochs, batches and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.functions.hashing import HASH_BITS, key_hash
from actlens.operators.ranking import bucket_offsets, global_rank, running_sum
from actlens.session import materialize

KEYS = ("doc_id", "n_raw_tokens")


def row_shuffle(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    dataset_id: str,
    partitions: int | None = None,
) -> DataFrame:
    """Seeded permutation of rows: adds ``shuffle_rank``, all columns move together.

    Row order is not a property of a table, so the order is a column. The hash
    range is cut into equal parts, one per output partition; wide rows cross the
    network once and end up sorted, so files written from the result are in
    shuffle order as well. ``partitions`` defaults to the session's shuffle
    partitions and does not change the ranks.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = _hash_ranges(df, key_hash(seed, dataset_id, *[F.col(k) for k in keys]), n)
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(bucket_offsets(counts, (), "_b").select("_b", "_off"))  # n rows
    inside = W.partitionBy("_b").orderBy("_h", *keys)
    return (
        hashed.repartitionById(n, F.col("_b"))
        .withColumn("_r", F.row_number().over(inside))
        .join(offsets, "_b")
        .withColumn("shuffle_rank", F.col("_off") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_off")
    )


def _hash_ranges(df: DataFrame, hashed: Column, n: int) -> DataFrame:
    """``_h`` and the number ``_b`` of its range, of ``n`` equal ranges of the hash."""
    part = F.shiftright(F.shiftright("_h", 20) * F.lit(n), HASH_BITS - 20).cast("int")
    return df.withColumn("_h", hashed).withColumn("_b", part)


def vector_shuffle(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    dataset_id: str,
    col: str = "activation_vector",
    partitions: int | None = None,
) -> DataFrame:
    """Permute one column only: each row takes the value of its successor in one random ring.

    All rows stand in hashed order of their keys, and the last is followed by the first. So every
    value is used once and no row keeps its own (unless it is alone). The result
    depends on (seed, dataset_id, keys) only.

    The wide rows cross the network once, to equal ranges of the hash. The last row of a range
    needs the first row of the next one: that row is found by the smallest hash of each range, and a
    copy of its value goes along with the range before it. ``partitions``, the number of
    ranges, defaults to the session's shuffle partitions and changes nothing.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_h", *keys]
    ranged = _hash_ranges(df, key_hash(seed, dataset_id, "activ", *[F.col(k) for k in keys]), n)
    heads = ranged.groupBy("_b").agg(F.min("_h").alias("_h"))  # n rows
    over = W.orderBy("_b")
    last = F.max("_b").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.withColumn("_to", F.coalesce(F.lag("_b").over(over), last))
    first = F.struct(*order)
    guests = (
        ranged.select(*order, "_b", F.struct(F.col(col).alias("v")).alias("_v"))
        .join(F.broadcast(heads), ["_b", "_h"])
        .groupBy("_to")
        .agg(F.min_by("_v", first).alias("_v"))
    )
    guests = materialize(guests, "range-heads").select(F.col("_to").alias("_b"), "_v", F.lit(True).alias("_guest"))
    rows = ranged.select("*", F.struct(F.col(col).alias("v")).alias("_v"), F.lit(False).alias("_guest")).drop(col)
    line = W.partitionBy("_b").orderBy("_guest", *order)
    return (
        rows.unionByName(guests, allowMissingColumns=True)
        .repartitionById(n, F.col("_b"))
        .withColumn("_next", F.lead("_v").over(line))
        .where(~F.col("_guest"))
        .select(*[F.col("_next.v").alias(c) if c == col else F.col(c) for c in df.columns])
    )


def permute_join(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    dataset_id: str,
    col: str = "activation_vector",
) -> DataFrame:
    """Permute one column by joining two rankings of the keys.

    Only keys are ranked; the column is joined back by the key it comes from,
    which is kept as ``source_<key>``. Use it where the mapping itself is wanted.
    """
    only_keys = df.select(*keys)
    to = global_rank(only_keys, keys, seed, salt=f"{dataset_id}|activ|to", out="_slot")
    source = global_rank(only_keys, keys, seed, salt=f"{dataset_id}|activ|from", out="_slot").select(
        "_slot", *[F.col(k).alias(f"source_{k}") for k in keys]
    )
    moved = df.select(*[F.col(k).alias(f"source_{k}") for k in keys], col)
    mapping = to.join(source, "_slot").drop("_slot")
    return df.drop(col).join(
        mapping.join(moved, [f"source_{k}" for k in keys]), list(keys)
    )


def epoch_shuffle(df: DataFrame, keys: Sequence[str], seed: int, epoch: int) -> DataFrame:
    """Permutation of one epoch, always drawn from the original rows."""
    marked = df.withColumn("epoch", F.lit(epoch).cast("bigint"))
    return global_rank(marked, keys, seed, salt="epoch", out="epoch_rank", group=["epoch"])


def batches(
    df: DataFrame,
    keys: Sequence[str],
    size: int,
    n_batches: int,
    seed: int | None = None,
    start: int = 0,
) -> DataFrame:
    """``n_batches`` batches of ``size`` rows, drawn epoch after epoch from offset ``start``.

    A batch that reaches past the end of an epoch goes on in the next one, as
    often as needed. ``seed=None`` draws in the order of one unique integer key.
    ``start`` resumes a draw, or takes unused rows back (see :func:`resume_offset`).
    """
    if size < 1 or n_batches < 1 or start < 0:
        raise ValueError("size and n_batches must be positive, start non-negative")
    stop = start + size * n_batches
    n = df.agg(F.count(F.lit(1))).scalar()
    only_keys = df.select(*keys)
    if seed is None:
        (order,) = keys
        ranked = running_sum(only_keys, [], order, F.lit(1), "_rank")
        epochs = F.sequence(F.floor(F.lit(start) / n), F.floor(F.lit(stop - 1) / n))
        ranked = ranked.withColumn("epoch", F.explode(epochs))
    else:
        epochs = F.sequence(F.floor(F.lit(start) / n), F.floor(F.lit(stop - 1) / n))
        placed = only_keys.withColumn("epoch", F.explode(epochs))

        def wanted(off: Column, rows: Column) -> Column:
            first = F.col("epoch") * n + off
            return (first < stop) & (first + rows > start)

        ranked = global_rank(
            placed, keys, seed, salt="epoch", out="_rank", group=["epoch"], keep=wanted
        )
    drawn = (
        ranked.withColumn("draw_index", F.col("epoch") * n + F.col("_rank") - F.lit(start))
        .where(F.col("draw_index").between(0, size * n_batches - 1))
        .withColumn("batch_id", F.floor(F.col("draw_index") / F.lit(size)))
        .drop("_rank")
    )
    return df.join(drawn, list(keys))


def resume_offset(offset: int | None, handed_back: int = 0, step: int = 0) -> int:
    """Offset to draw from: unused rows go back, but not past the start.

    No saved offset is an error for any step after the first.
    """
    if offset is None:
        if step > 0:
            raise ValueError(f"no saved offset for step {step}")
        offset = 0
    return max(0, offset - handed_back)


def group_index(df: DataFrame, n: int, draw: str = "draw_index") -> DataFrame:
    """Consecutive group number per drawn row and the first sample number in it."""
    return df.withColumn("group_index", F.col(draw)).withColumn(
        "first_sample_index", F.col(draw) * F.lit(n)
    )


def sample_groups(df: DataFrame, n: int, draw: str = "draw_index") -> DataFrame:
    """Each drawn row ``n`` times, with ``group_index`` and ``sample_index``."""
    return (
        group_index(df, n, draw)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("sample_index", F.col("first_sample_index") + F.col("copy"))
        .drop("first_sample_index", "copy")
    )


def chunk_ids(df: DataFrame, keys: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """Number the rows in hashed order and cut them into chunks of ``size``."""
    ranked = global_rank(df, keys, seed, salt="chunk", out="_rank")
    return ranked.withColumn("chunk_id", F.floor(F.col("_rank") / F.lit(size))).drop("_rank")


def even_slices(df: DataFrame, start: int, length: int, n: int, idx: str = "doc_idx") -> DataFrame:
    """Rows of ``[start, start + length)`` dealt to ``n`` workers, the remainder to the last."""
    if not 1 <= n <= length:
        raise ValueError(f"cannot cut {length} rows into {n} slices")
    inside = df.where(F.col(idx).between(start, start + length - 1))
    worker = F.least(F.floor((F.col(idx) - start) / F.lit(length // n)), F.lit(n - 1))
    return inside.withColumn("worker", worker.cast("bigint"))


def reshard(df: DataFrame, shard: str, n: int) -> DataFrame:
    """Shard ``i`` goes to worker ``i mod n``."""
    return df.withColumn("worker", F.pmod(F.col(shard), F.lit(n)))


def shard_min(df: DataFrame, shard: str) -> DataFrame:
    """One row: the smallest row count over the shards, and how many shards there are."""
    return (
        df.groupBy(shard)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.min("_n").alias("min_rows"), F.count(F.lit(1)).alias("shards"))
    )


def equal_shards(
    df: DataFrame, shard: str, order: str, micro_batch: int | None = None
) -> DataFrame:
    """First rows (by integer ``order``) of each shard, the same number in every shard.

    That number is the smallest shard's, rounded down to a multiple of
    ``micro_batch``; nothing left is an error.
    """
    step = F.lit(micro_batch or 1)
    least = shard_min(df, shard).select(F.col("min_rows")).scalar()
    rows = F.floor(least / step) * step
    checked = F.when(rows > 0, rows).otherwise(
        F.raise_error(F.lit("the smallest shard holds no whole micro-batch")).cast("bigint")
    )
    numbered = running_sum(df, [shard], order, F.lit(1), "_idx")
    return numbered.where(F.col("_idx") < checked).drop("_idx")


def packed_offsets(df: DataFrame, length: str, batch: str, order: str) -> DataFrame:
    """Start offset and last-token index of each sequence in its packed batch."""
    return running_sum(df, [batch], order, F.col(length), "start_offset").withColumn(
        "last_index", F.col("start_offset") + F.col(length) - 1
    )
