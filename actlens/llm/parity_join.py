"""Near duplicates: shingle sets joined by parity sketches.

The tokens (shingles) of a set are XOR-ed into the blocks of a sketch. One token more
or less changes one block, so the number of blocks that differ is at most the symmetric
difference. Sets that are similar enough differ in at most d tokens, with d known from
their size; among the first d + 1 blocks that hold anything one is equal, and a join on
(size band, block, value) finds every such pair. Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import packed, whole
from actlens.llm.components import components
from actlens.llm.word_hash import mix, shingle_set, text_words
from actlens.session import materialize

# Two sets link when PER_CENT * union <= 100 * intersection.
PER_CENT = 85
WIDTH = 4
WORD_BITS = 64
# Parity bits per token of a set, at least. The more, the closer their distance is to the difference.
TOKEN_BITS = 4
# Parity bits of a row that is repeated for each of its blocks, at most.
SHORT_BITS = 1024
# Keys by which a row knows whether a pair meets at a smaller key too.
LEAST_KEYS = 8
SEEN = 1_000_000


class Bands:
    """Size bands and the number of differing tokens that a link allows."""

    def __init__(self, per_cent: int):
        self.p, self.q = per_cent, 100 - per_cent

    def of_size(self, n: int) -> int:
        """Most tokens in which a set of ``n`` differs from one it links with."""
        return self.q * n // self.p

    def of_sizes(self, a: int, b: int) -> int:
        """The same for two sets of these sizes (or smaller ones)."""
        return self.q * (a + b) // (100 + self.p)

    def groups(self, n: int) -> list[tuple[int, int, int]]:
        """(group, blocks, allowed) for a set of ``n``: its band, and the border zone it may lie in.

        Bands double in size. Sets of one band meet in the band's group; sets on both
        sides of a border, near enough to link, meet in the border's group.
        """
        out = []
        band = n.bit_length()
        top = (1 << band) - 1
        out.append((2 * band, self.of_sizes(top, top) + 2, min(self.of_size(n), self.of_sizes(n, top))))
        low = 1 << (band - 1)  # border below: partners up to low - 1
        if n * self.p <= (low - 1) * 100:
            out.append((2 * band - 1, self.border(low), self.of_sizes(n, low - 1)))
        high = 1 << band  # border above: partners from high on
        if n * 100 >= high * self.p:
            out.append((2 * band + 1, self.border(high), self.of_size(n)))
        return out

    def border(self, at: int) -> int:
        return self.of_size(at) + 3


def block_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: group, block and XOR of the block's tokens, hashed to 64 bits.

    Blocks are ranges of the token hash, so the sorted set is already in blocks. A set
    without d + 1 filled blocks gives all its blocks, the empty ones too: of two
    sets that link, either the one with fewer blocks given finds an equal filled
    block, or both give all.
    """
    n = len(tokens)
    if not n or not bands.of_size(n):
        return np.zeros(0, np.uint64)  # only equal sets can link
    high = tokens >> np.uint64(32)
    running = np.zeros(n + 1, np.uint64)
    np.bitwise_xor.accumulate(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=running[1:])
    keys = []
    for group, blocks, allowed in bands.groups(n):
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        values = running[np.append(first[1:], n)] ^ running[first]
        filled = block[first]
        if len(filled) > allowed:
            filled, values = filled[: allowed + 1], values[: allowed + 1]
        else:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), filled)
            filled = np.concatenate([filled, empty])
            values = np.concatenate([values, np.zeros(len(empty), np.uint64)])
        keys.append(mix(values + mix(filled + mix(np.full(len(filled), group, np.uint64)))))
    return np.concatenate(keys)


def sketch_bits(tokens: np.ndarray, longest: int | None = None) -> np.ndarray:
    """The set as parity bits in signed 64-bit words: each token flips one bit.

    A sketch has a power of two of bits, ``TOKEN_BITS`` or more for each token, so sets of any size fill about as
    much of it; or ``longest`` bits, if that is less.
    """
    bits = max(WORD_BITS, TOKEN_BITS << (len(tokens) - 1).bit_length())
    bits = min(bits, longest or bits)
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a whole set."""
    both = mix(np.array([np.bitwise_xor.reduce(mix(tokens)), tokens.sum(dtype=np.uint64)], np.uint64))
    return int(_signed(mix(both[:1] * np.uint64(31) + both[1:] + np.uint64(len(tokens))))[0])


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    texts = [t.as_py().encode().lower() for t in batch.column("text")]
    for words in text_words(texts):
        yield shingle_set(words, width)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _signatures(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n``, ``node`` (fingerprint of the set), ``bits`` and ``short`` (parity bits) per row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, width))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                "bits": _lists([sketch_bits(s) for s in sets]),
                "short": _lists([sketch_bits(s, SHORT_BITS) for s in sets]),
            })

    schema = f"doc_id {kind}, text_hash long, n long, node long, bits array<long>, short array<long>"
    return rows.mapInArrow(sign, schema)


def _block_rows(rows: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``key``, ``node``: one row per block given. A task gives the blocks of equal sets once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for tokens in _sets(batch, width):
                if not len(tokens):
                    continue
                node = fingerprint(tokens)
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                keys.append(block_keys(tokens, bands))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            yield pa.RecordBatch.from_pydict({"key": _signed(np.concatenate(keys)), "node": np.concatenate(nodes)})

    return rows.select("text").mapInArrow(blocks, "key long, node long")


def _shared(block_rows: DataFrame) -> DataFrame:
    """``key``, ``node``, ``hub`` of blocks that several nodes give; the hub is the smallest of them.

    The rows come sorted by (key, node), so equal keys are a run; of a run that goes on
    in the next Arrow batch only its first row is remembered.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = hub = None
        told = False  # whether the hub's own row of the open run has been given
        for batch in batches:
            key = batch.column("key").to_numpy()
            node = batch.column("node").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if last_key is not None and len(key):
                new[0] = (key[0], node[0]) != (last_key, last_node)
            key, node = key[new], node[new]
            if not len(key):
                continue
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            goes_on = last_key is not None and key[0] == last_key
            if goes_on:
                head[0] = False
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            hubs = np.where(at >= 0, node[at], hub if hub is not None else 0)
            follows = np.append(~head[1:], False)  # the next row belongs to the same run
            keep = ~head | follows
            out_key, out_node, out_hub = key[keep], node[keep], hubs[keep]
            if goes_on and not told:
                out_key = np.concatenate([[last_key], out_key])
                out_node = np.concatenate([[hub], out_node])
                out_hub = np.concatenate([[hub], out_hub])
            one_open = head[-1]
            last_key, last_node, hub, told = key[-1], node[-1], hubs[-1], not one_open
            if len(out_key):
                yield pa.RecordBatch.from_pydict({"key": out_key, "node": out_node, "hub": out_hub})

    ordered = block_rows.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(runs, "key long, node long, hub long")


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    return pairs.join(of_b.hint("merge"), "b").join(of_a.hint("merge"), "a").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def _may_link(per_cent: int, bits: str = "bits") -> Column:
    """Whether sizes and parity bits of ``l`` and ``r`` allow a link: both bound the difference from below.

    The longer sketch is folded to the shorter: words a whole length apart are XOR-ed.
    """
    left, right = f"l.{bits}", f"r.{bits}"
    total = "aggregate(zip_with({}, {}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    shorter = f"least(size({left}), size({right}))"
    folded = "transform(sequence(0, {m} - 1), i -> aggregate(sequence(i, size({x}) - 1, {m}), 0L, (s, j) -> s ^ {x}[j]))"
    other = [folded.format(x=x, m=shorter) for x in (left, right)]
    differ = F.expr(f"if(size({left}) = size({right}), {total.format(left, right)}, {total.format(*other)})")
    return _sizes_may_link(per_cent) & (
        differ * (100 + per_cent) <= (F.col("l.n") + F.col("r.n")) * (100 - per_cent)
    )


def _sizes_may_link(per_cent: int) -> Column:
    return F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * per_cent


def _likely(pairs: DataFrame, about: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose sizes and whole sketches allow a link."""
    of_b = about.select(F.col("node").alias("b"), F.struct("n", "bits").alias("r"))
    of_a = about.select(F.col("node").alias("a"), F.struct("n", "bits").alias("l"))
    return pairs.join(of_b, "b").join(of_a, "a").where(_may_link(per_cent)).select("a", "b")


def _pairs_apart(rest: DataFrame, per_cent: int) -> DataFrame:
    """``a``, ``b``: rows of one key (``key``, ``node``, ``component``, ``n``, ``short``) that may link, but are in two components.

    A pair comes from the smallest of its keys, not from each: every row has the least keys of its node, and gives a
    pair only where no smaller one is known to both. Where the two know none in common, each key gives the pair.
    """
    least = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    rows = rest.join(least, "node")  # a node has as many keys as its own sketch
    left, right = rows.alias("l"), rows.alias("r")
    apart_yet = (F.col("l.node") < F.col("r.node")) & (F.col("l.component") != F.col("r.component"))
    smallest = F.coalesce(F.array_min(F.array_intersect("l.least", "r.least")), F.col("l.key")) == F.col("l.key")
    same = (F.col("l.key") == F.col("r.key")) & apart_yet & _sizes_may_link(per_cent) & smallest
    return (
        left.join(right, same & _may_link(per_cent, "short"))
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, per_cent: int = PER_CENT
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id`` and ``first`` for every row.

    Words are split at ASCII white space after lower-casing A-Z; a set holds the distinct
    shingles of ``width`` words, or the whole sequence if it is shorter. ``component_id``
    is the smallest id that links reach; ``first`` marks the row that has it.

    * Null, empty and blank texts have no shingles and link with nothing.
    * Equal sets link; repeated rows are one node. Null ids sort after others, and a
      component of null ids alone has a null ``component_id``.
    * An empty table gives an empty result. Other columns are not read.

    Shingles, sets and blocks are compared by 64-bit hashes. Copies collapse to one node
    before blocks are dealt. In a block the members are first compared with a hub. Of what this
    leaves in different components, sizes and parity bits are compared within a block, and a pair
    that they allow is given once, not once for each block it shares; its whole sets are verified.
    """
    spark = docs.sparkSession
    bands = Bands(per_cent)
    kind = docs.schema[id].dataType.simpleString()
    rows = packed(docs).select(
        F.col(f"row.{id}").alias("doc_id"),
        F.xxhash64(whole(F.col(f"row.{text}"))).alias("text_hash"),
        whole(F.col(f"row.{text}")).alias("text"),
    )
    signed = materialize(_signatures(rows, kind, width), "signatures")
    shared = materialize(_shared(_block_rows(rows, width, bands)), "shared-blocks")

    # One row per distinct set: copies are counted in the map tasks, and the joins below see plain rows, so
    # that a hub's many rows can be split.
    sort_key = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    about = materialize(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            *(F.first(c).alias(c) for c in ("n", "bits", "short")),
            F.min(sort_key).alias("least"),
            F.count(F.lit(1)).alias("rows"),
        ),
        "nodes",
    )

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """Whole sets of the nodes of ``pairs``, from one row of each node."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        owner = about.join(wanted, "node", "left_semi").select("node", "least.doc_id", "least.text_hash")
        return materialize(_token_sets(rows, owner, width), name)

    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # Sizes and parity bits are compared first, so that only sets that may link are moved.
    likely = materialize(_likely(stars, about, per_cent), "likely")
    sets = sets_of(likely, "sets")
    # One hub per node joins most of a group, so the other hubs' pairs need no sets moved.
    nearest = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = materialize(_verified(nearest, sets, per_cent), "first-links")
    joined = components(first)
    of_a = joined.select(F.col("node").alias("a"), F.col("component").alias("x"))
    of_b = joined.select(F.col("node").alias("b"), F.col("component").alias("y"))
    others = (
        likely.join(nearest, ["a", "b"], "left_anti")
        .join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .where(F.coalesce("x", "a") != F.coalesce("y", "b"))
        .select("a", "b")
    )
    second = materialize(_verified(materialize(others, "other-stars"), sets, per_cent), "star-links")
    reached = components(first.unionByName(second))

    # What the hubs left apart.
    found = shared.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = found.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    short = about.select("node", "n", "short")
    rest = materialize(
        found.join(apart.select("key"), "key", "left_semi").where("node <> hub").drop("hub").join(short, "node"), "apart"
    )
    pairs = materialize(_pairs_apart(rest, per_cent), "apart-pairs")
    pairs = materialize(_likely(pairs, about, per_cent), "apart-likely")
    more = _verified(pairs, sets_of(pairs, "apart-sets"), per_cent)
    star = reached.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(star.unionByName(more))

    classes = about.select("node", "least", "rows")
    grouped = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("least").alias("head"), F.sum("rows").alias("size")).where("size > 1")
    heads = grouped.join(least, "component").select("node", "head")
    return (
        signed.join(heads, "node", "left")
        .withColumn("alone", F.col("head").isNull())
        .select(
            "doc_id",
            "text_hash",
            F.col("n").alias("n_shingles"),
            F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
            (F.col("alone") | F.col("head").eqNullSafe(sort_key)).alias("first"),
        )
    )


def _token_sets(rows: DataFrame, owner: DataFrame, width: int) -> DataFrame:
    """``node``, ``tokens`` (sorted) of the owners' texts."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(s) for s in _sets(batch, width)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "tokens": _lists(sets)})

    # Repeated rows are dropped while they are texts, in the partitions that the join made.
    at = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_hash").alias("at")
    # Owners grow with the corpus, so they are merged at every size and never broadcast.
    texts = rows.select(at, "text").join(owner.select(at, "node").hint("merge"), "at").dropDuplicates(["at"])
    return texts.select("node", "text").mapInArrow(tokens, "node long, tokens array<long>")


def representatives(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """One document of each component of :func:`near_duplicates`, with the columns of ``docs``."""
    found = near_duplicates(docs, text, id, **options)
    gone = found.where(~F.col("first")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
    rows = packed(docs)
    same = F.col(f"row.{id}").eqNullSafe(F.col("g_id")) & (F.xxhash64(whole(F.col(f"row.{text}"))) == F.col("g_hash"))
    return rows.join(gone.hint("merge"), same, "left_anti").select("row.*")
