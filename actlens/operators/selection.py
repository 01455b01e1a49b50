"""Rows and values at given ranks, by a distributed radix select.

A group is never sorted. Its rows are counted by the leading bits of an order-preserving
key, in the map tasks; the bucket that holds a wanted rank is cut again by the next
bits, between its own smallest and largest key, until it is small. Only counts are
exchanged, and at the end the keys of the small buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.functions.binding import let
from actlens.session import materialize

# Bits told apart in a round: at most 2 ** BITS + 1 counts per bucket and map task.
BITS = 12
# Rows of a bucket whose keys are put in order in one piece: half a megabyte.
SMALL = 1 << 15
# Buckets (wanted ranks of all groups) that are broadcast; more are joined by shuffles.
MOST = 50_000



def ordered_bits(value: Column) -> Column:
    """BIGINT that sorts like the double ``value`` (-0.0 as 0.0, NaN last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0))
    return let(bits.cast("bigint"), _flipped)


def from_ordered_bits(bits: Column) -> Column:
    """The double that :func:`ordered_bits` came from."""
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), let(bits, _flipped)).cast("double")


def _flipped(bits: Column) -> Column:
    """Negative doubles have descending bits; turning them over is its own inverse."""
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def _shifted(key: Column | str, by: Column | str) -> Column:
    return F.call_function("shiftright", key, by)


def _span_bits(lo: str, hi: str) -> Column:
    """Bits to drop so that ``lo`` … ``hi`` spans at most 2 ** BITS + 1 values."""
    span = F.col(hi).cast("double") - F.col(lo).cast("double") + F.lit(1.0)
    return F.greatest(F.lit(0), F.ceil(F.log2(span)).cast("int") - F.lit(BITS))


@dataclass
class _Table:
    """One row per bucket or interval; ``found`` has its rows if they were counted and may be broadcast."""

    rows: DataFrame
    found: list | None = None

    def join_to(self, df: DataFrame, by: Sequence[str], on: Column) -> DataFrame:
        """``df`` with the rows of its group that ``on`` admits; a filter of ``df`` where this is small."""
        side = self.rows.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
        for i, c in enumerate(by):
            on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
        out = df.join(side if self.found is None else F.broadcast(side), on)
        return out.drop(*[f"_by{i}" for i in range(len(by))])

    def select(self, *columns: str | Column) -> _Table:
        return _Table(self.rows.select(*columns), self.found)


def _local(rows: list, like: DataFrame) -> _Table:
    return _Table(like.sparkSession.createDataFrame(rows, like.schema), rows)


def _held(rows: DataFrame, name: str) -> _Table:
    """The table by value if it has at most MOST rows, else stored."""
    found = rows.limit(MOST + 1).collect()
    return _local(found, rows) if len(found) <= MOST else _Table(materialize(rows, name))


# A bucket: the box of its keys, the rows before it and in it, the rows of its group, the wanted ranks.
_BUCKET = ("_k_lo", "_k_hi", "_t_lo", "_t_hi", "_off", "_n", "_rows", "_ranks")


def _wanted(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The buckets that hold a wanted rank, with the ranks they hold."""
    held = F.filter("_ranks", lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_n")))
    return buckets.withColumn("_ranks", held).where(F.size("_ranks") > 0).select(*by, *_BUCKET)


def _divided(buckets: _Table, small: int) -> tuple[_Table, _Table]:
    """The buckets to be cut again, and the others: small ones and those of one key."""
    if buckets.found is not None:
        cut = [r["_n"] > small and (r["_k_lo"] < r["_k_hi"] or r["_t_lo"] < r["_t_hi"]) for r in buckets.found]
        parts = [[r for r, c in zip(buckets.found, cut) if c is side] for side in (True, False)]
        return _local(parts[0], buckets.rows), _local(parts[1], buckets.rows)
    large = (F.col("_n") > small) & ((F.col("_k_lo") < F.col("_k_hi")) | (F.col("_t_lo") < F.col("_t_hi")))
    return _held(buckets.rows.where(large), "buckets"), _Table(buckets.rows.where(~large))


def _in_box() -> Column:
    return F.col("_k").between(F.col("_k_lo"), F.col("_k_hi")) & F.col("_t").between(F.col("_t_lo"), F.col("_t_hi"))


def refined(keyed: DataFrame, buckets: _Table, by: Sequence[str]) -> DataFrame:
    """The buckets cut by their next bits: of the value, or of the tie where all values are one."""
    bits = {"_k_bits": _span_bits("_k_lo", "_k_hi"), "_t_bits": _span_bits("_t_lo", "_t_hi")}
    rows = buckets.select("*", *[c.alias(name) for name, c in bits.items()]).join_to(keyed, by, _in_box())
    by_value = _shifted("_k", "_k_bits") - _shifted("_k_lo", "_k_bits")
    by_tie = _shifted("_t", "_t_bits") - _shifted("_t_lo", "_t_bits")
    parent = [*by, "_off"]
    cut = (
        rows.withColumn("_digit", F.when(F.col("_k_lo") == F.col("_k_hi"), by_tie).otherwise(by_value))
        .groupBy(*parent, "_digit")
        .agg(
            F.min("_k").alias("_k_lo"), F.max("_k").alias("_k_hi"), F.min("_t").alias("_t_lo"), F.max("_t").alias("_t_hi"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    # At most 2 ** BITS + 1 digits in one window.
    before = W.partitionBy(*parent).orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("_first", F.col("_off") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    known = buckets.select(*by, F.col("_off").alias("_parent"), "_rows", "_ranks")
    cut = known.join_to(cut, by, F.col("_off") == F.col("_parent"))
    return _wanted(cut.withColumn("_off", F.col("_first")), by)


def keys_at_ranks(
    keyed: DataFrame, by: Sequence[str], ranks: Callable[[Column], Column], small: int = SMALL
) -> DataFrame:
    """The keys at the 0-based ranks ``ranks(group size)`` (an array) of each group.

    ``keyed`` is a stored table of ``by``, ``_k`` and ``_t``, two BIGINTs to order by. The result has
    ``by``, ``rank``, ``group_rows``, the key ``_k``, ``_t`` at that rank, and ``first_rank``, the smallest
    rank with that key. Ranks outside the group give nothing.
    """
    by = list(by)
    groups = keyed.groupBy(*by).agg(
        F.min("_k").alias("_k_lo"), F.max("_k").alias("_k_hi"), F.min("_t").alias("_t_lo"), F.max("_t").alias("_t_hi"),
        F.lit(0).cast("bigint").alias("_off"), F.count(F.lit(1)).alias("_n"),
    )
    groups = groups.withColumn("_rows", F.col("_n")).withColumn("_ranks", F.array_distinct(ranks(F.col("_n"))))
    large, done = _divided(_held(_wanted(groups, by), "buckets"), small)
    parts = [done]
    while not (large.rows.isEmpty() if large.found is None else not large.found):
        large, done = _divided(_held(refined(keyed, large, by), "buckets"), small)
        parts.append(done)
    local = [r for part in parts if part.found is not None for r in part.found]
    tables = [_local(local, groups.select(*by, *_BUCKET))] if len(local) <= MOST else [p for p in parts if p.found is not None]
    return _union([_settled(keyed, part, by) for part in [*tables, *[p for p in parts if p.found is None]]])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:  # one per round
        out = out.unionByName(part)
    return out


def _settled(keyed: DataFrame, buckets: _Table, by: list[str]) -> DataFrame:
    """Keys at the ranks of buckets of one key, or of few rows, whose keys are put in order."""
    single = (F.col("_k_lo") == F.col("_k_hi")) & (F.col("_t_lo") == F.col("_t_hi"))
    plain = ["_off", "_rows", "_ranks"]
    one = F.array(F.struct(F.col("_k_lo").alias("k"), F.col("_t_lo").alias("t")))
    ones = buckets.rows.where(single).select(*by, *plain, one.alias("_keys"), F.lit(True).alias("_one"))
    rows = _Table(buckets.rows.where(~single), buckets.found).join_to(keyed, by, _in_box())
    keys = F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_t").alias("t"))))  # a small bucket
    several = rows.groupBy(*by, *plain).agg(keys.alias("_keys"), F.lit(False).alias("_one"))
    found = ones.unionByName(several).withColumn("rank", F.explode("_ranks"))
    place = F.when(F.col("_one"), 1).otherwise(F.col("rank") - F.col("_off") + 1).cast("int")
    found = found.withColumn("_key", F.element_at("_keys", place))
    return found.select(
        *by,
        "rank",
        F.col("_rows").alias("group_rows"),
        F.col("_key.k").alias("_k"),
        F.col("_key.t").alias("_t"),
        (F.col("_off") + F.array_position("_keys", F.col("_key")) - 1).alias("first_rank"),
    )


def _keyed(df: DataFrame, by: Sequence[str], value: Column, tie: Column) -> DataFrame:
    rows = df.where(value.isNotNull()).select(*by, ordered_bits(value).alias("_k"), tie.cast("bigint").alias("_t"))
    return materialize(rows, "ordered-keys")


def rows_at_ranks(
    df: DataFrame, by: Sequence[str], value: Column, tie: str, intervals: Callable[[Column], Column], small: int = SMALL
) -> DataFrame:
    """Rows of each group whose 0-based rank (ascending value, then the integer ``tie``) is asked for.

    ``intervals`` maps the group size to an array of structs ``(tag, lo, hi)``; the result has one
    row per (row, interval) with ``rank``, ``group_rows`` and ``tag``. NULL values take no place. ``df`` is
    read for its keys and once more for the rows, which are filtered by the keys at
    the ends of the intervals; only rows asked for are exchanged.
    """
    by = list(by)

    def clipped(n: Column) -> Column:
        return F.transform(
            intervals(n),
            lambda t: F.struct(
                t["tag"].alias("tag"),
                F.greatest(t["lo"].cast("bigint"), F.lit(0)).alias("lo"),
                F.least(t["hi"].cast("bigint"), n).alias("hi"),
            ),
        )

    def ends(n: Column) -> Column:
        some = F.filter(clipped(n), lambda t: t["lo"] < t["hi"])
        return F.flatten(F.transform(some, lambda t: F.array(t["lo"], t["hi"] - 1)))

    keys = keys_at_ranks(_keyed(df, by, value, F.col(tie)), by, ends, small)
    key = F.struct(F.col("_v").alias("v"), F.col("_t").alias("t"), "first_rank")
    bounds = (
        keys.withColumn("_v", from_ordered_bits(F.col("_k")))
        .groupBy(*by, "group_rows")
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", key.alias("key")))).alias("_ends"))  # two per interval
        .withColumn("_i", F.explode(clipped(F.col("group_rows"))))
        .where("_i.lo < _i.hi")
        .select(
            *by, "group_rows", F.col("_i.tag").alias("tag"), F.col("_i.lo").alias("_lo"), F.col("_i.hi").alias("_hi"),
            F.element_at("_ends", F.col("_i.lo")).alias("_first"), F.element_at("_ends", F.col("_i.hi") - 1).alias("_last"),
        )
    )
    mine = F.struct((value.cast("double") + F.lit(0.0)).alias("v"), F.col(tie).cast("bigint").alias("t"))
    between = (F.col("_mine") >= F.struct("_first.v", "_first.t")) & (F.col("_mine") <= F.struct("_last.v", "_last.t"))
    keyed = df.where(value.isNotNull()).withColumn("_mine", mine)
    inside = W.partitionBy(*by, "tag").orderBy("_mine")
    return (
        _held(bounds, "intervals").join_to(keyed, by, between)
        .withColumn("rank", F.col("_first.first_rank") + F.row_number().over(inside) - 1)
        .where((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
        .drop("_mine", "_first", "_last", "_lo", "_hi")
    )


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], small: int = SMALL
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``points``; NULLs are left out."""

    def position(n: Column, q: float) -> Column:
        return (n - 1).cast("double") * F.lit(q)

    def asked(n: Column) -> Column:
        low = [F.floor(position(n, q)) for q in points.values()]
        return F.flatten(F.array(*[F.array(at, at + 1) for at in low]))

    keyed = _keyed(df.select(*by, value), by, F.col(value), F.lit(0))
    found = keys_at_ranks(keyed, by, asked, small).withColumn("_v", from_ordered_bits(F.col("_k")))

    def interpolated(q: float) -> Column:
        at = position(F.col("group_rows"), q)
        low = F.floor(at)
        weight = F.when(F.col("rank") == low, 1 - (at - low)).when(F.col("rank") == low + 1, at - low)
        return F.sum(F.when(weight > 0, F.col("_v") * weight))

    return found.groupBy(*by).agg(*[interpolated(q).alias(name) for name, q in points.items()])
