"""Repeated byte windows by a depth-limited radix sort of suffixes.

Two suffixes matter only through their first WINDOW bytes, so sorting them to that
depth puts equal windows into equal groups, and a group of two or more is a repeated
window. The sort goes digit by digit, and what is alone in its group drops out:

1. the window's anchor, the gram in it with the smallest hash;
2. the span of all windows of that anchor: equal spans settle all of them at once;
3. for spans that differ but share an anchor, half of the other bytes, left or right;
4. the whole window.

Digits 1 and 2 are one row per anchor (about one in 75 bytes) instead of one per suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actlens.llm.common import packed, whole
from actlens.llm.repeat_windows import Hashes, anchors, covered
from actlens.llm.word_hash import mix
from actlens.session import materialize

WINDOW = 200
GRAM = 48
# Spans of one group that a task compares in memory; a larger group goes window by
# window through an aggregation.
TOGETHER = 20_000
_ANCHOR = ("gram", "span", "first", "last", "place")


def _anchor_rows(rows: DataFrame, kind: str, window: int, gram: int, collapse: bool) -> DataFrame:
    """One row per anchor; ``collapse`` leaves one of equal (gram, span) in a batch and counts them in ``n``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, text in enumerate(batch.column("text")):
                for part in anchors(text.as_py().encode(), window, gram):
                    found.append(part)
                    owner.append(np.full(len(part[0]), i))
            if not found:
                continue
            columns = dict(zip(_ANCHOR, map(np.concatenate, zip(*found))))
            owners = np.concatenate(owner)
            if collapse:
                order = np.lexsort((columns["span"], columns["gram"]))
                g, s = columns["gram"][order], columns["span"][order]
                head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]))
                kept = order[head]
                columns = {k: v[kept] for k, v in columns.items()}
                columns["n"] = np.diff(np.append(head, len(order)))
                owners = owners[kept]
            else:
                columns = {k: columns[k] for k in ("gram", "span", "first")}
            who = pa.array(owners)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(who), "text_hash": batch.column("text_hash").take(who)}
                | {k: pa.array(v, pa.int64()) for k, v in columns.items()}
            )

    names = [*_ANCHOR, "n"] if collapse else ["gram", "span", "first"]
    schema = f"doc_id {kind}, text_hash long, " + ", ".join(f"{name} long" for name in names)
    return rows.mapInArrow(find, schema)


def _squeezed(rows: DataFrame, kind: str) -> DataFrame:
    """The texts as compressed bytes, for the shuffles that move them."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = [press.compress(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "body": pa.array(body, pa.binary()),
            })

    return rows.mapInArrow(squeeze, f"doc_id {kind}, text_hash long, body binary")


def _halves(texts: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """Digit 3: the spans of ``wanted``, keyed by the anchor and half of the bytes around it.

    A window has window - gram bytes beside its anchor, so half of that lies wholly to
    the left or wholly to the right. Each window is in one row: ``offset`` is that
    of the row's first window from the span's first, ``windows`` their number.
    """
    half = (window - gram) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "gram", "span", "n", "offset", "windows", "lead", "bytes")}
            for body, asked in zip(batch.column("body"), batch.column("asked")):
                raw = press.decompress(body.as_py())
                for a in asked.as_py():
                    first, last, place = a["first"], a["last"], a["place"]
                    turn = max(first, place - half + 1)  # starts before it have a long left side
                    for lo, hi, near in (
                        (first, min(last, turn - 1), raw[place - half : place] if turn > first else b""),
                        (turn, last, raw[place + gram : place + gram + half]),
                    ):
                        if lo > hi:
                            continue
                        side = b"L" if hi < turn else b"R"
                        digest = hashlib.blake2b(side + near, digest_size=8, key=a["gram"].to_bytes(8, "little", signed=True))
                        out["key"].append(int.from_bytes(digest.digest(), "little", signed=True))
                        out["gram"].append(a["gram"])
                        out["span"].append(a["span"])
                        out["n"].append(a["n"])
                        out["offset"].append(lo - first)
                        out["windows"].append(hi - lo + 1)
                        out["lead"].append(place - lo)
                        out["bytes"].append(raw[lo : hi + window])
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()}
            )

    asked = wanted.groupBy("doc_id", "text_hash").agg(  # a text's anchors, at most its length
        F.collect_list(F.struct("gram", "span", "n", "first", "last", "place")).alias("asked")
    )
    same = F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.text_hash") == F.col("a.text_hash"))
    joined = texts.alias("t").join(asked.alias("a"), same).select("t.body", "a.asked")
    schema = "key long, gram long, span long, n long, offset long, windows long, lead long, bytes binary"
    return joined.mapInArrow(cut, schema)


def _compare(halves: DataFrame, window: int, together: int) -> DataFrame:
    """Digit 4: ``gram``, ``span``, ``from``, ``to``: the repeated windows of spans that occur once.

    Rows with ``whole`` set belong to groups too large to hold; they are single windows,
    still to be counted.
    """

    def windows_of(row: dict) -> np.ndarray:
        starts = np.arange(row["windows"])
        hashes = Hashes(np.frombuffer(row["bytes"], np.uint8)).of(starts, starts + window)
        return mix(hashes + mix((row["lead"] - starts).astype(np.uint64) + np.uint64(row["gram"] & (2**63 - 1))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "span", "from", "to", "whole", "n")

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))

        def single(row: dict) -> list[tuple]:
            values = windows_of(row).view(np.int64).tolist()
            at = row["offset"]
            return [(row["gram"], row["span"], at + i, at + i, v, row["n"]) for i, v in enumerate(values)]

        def settle(group: list[dict]) -> list[tuple]:
            if len(group) < 2:
                return []
            hashes = [windows_of(r) for r in group]
            weights = np.concatenate([np.full(len(h), r["n"]) for r, h in zip(group, hashes)])
            _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            repeated = np.bincount(inverse, weights)[inverse] >= 2
            rows, at = [], 0
            for r, h in zip(group, hashes):
                mine = repeated[at : at + len(h)]
                at += len(h)
                if r["n"] == 1 and mine.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).view(np.int8)))
                    rows += [(r["gram"], r["span"], r["offset"] + int(a), r["offset"] + int(b) - 1, None, 1)
                             for a, b in zip(edge[::2], edge[1::2])]
            return rows

        key, group, large, rows, before = None, [], False, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if not large:
                        rows += settle(group)
                    key, group, large, before = row["key"], [], False, None
                if before == (before := (row["gram"], row["span"])):
                    continue  # the owner is a repeated row
                if large:
                    rows += single(row)
                else:
                    group.append(row)
                    if len(group) > together:
                        for r in group:
                            rows += single(r)
                            if len(rows) > 100_000:
                                yield out(rows)
                                rows = []
                        group, large = [], True
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
        if not large:
            rows += settle(group)
        yield out(rows)

    schema = "gram long, span long, `from` long, `to` long, whole long, n long"
    return halves.repartition("key").sortWithinPartitions("key", "gram", "span").mapInArrow(compare, schema)


def repeated_bytes(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    together: int = TOGETHER,
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``body`` (compressed text) and ``removed`` per row.

    ``removed`` lists the maximal byte ranges (``from``, ``to``; end exclusive) covered by a
    string of ``window`` bytes that also starts anywhere else, judged on the input.

    * A null text is empty; texts shorter than ``window`` have nothing removed.
    * Repeated rows repeat each other wholly; null ids are rows like others.
    * An empty table gives an empty result. Other columns are not read.

    Spans and windows are compared by 64-bit hashes inside groups that share an anchor.
    Copies collapse to one row per batch before the first shuffle.
    """
    kind = docs.schema[id].dataType.simpleString()
    body = whole(F.col(f"row.{text}"))
    rows = packed(docs).select(F.col(f"row.{id}").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    owner = ["doc_id", "text_hash", "first", "last", "place"]
    spans = (
        _anchor_rows(rows, kind, window, gram, collapse=True)
        .repartition("gram")
        .groupBy("gram", "span")
        .agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in owner])
    )
    # The groups of a gram are already together: nothing moves again.
    of_gram = W.partitionBy("gram")
    counted = spans.withColumn("total", F.sum("n").over(of_gram)).withColumn("kinds", F.count(F.lit(1)).over(of_gram))
    shared = materialize(counted.where("total > 1"), "spans")
    texts = _squeezed(rows, kind)
    compared = materialize(
        _compare(_halves(texts, shared.where("kinds > 1"), window, gram), window, together), "window-ranges"
    )
    many = compared.where("whole IS NOT NULL")
    often = many.groupBy("whole").agg(F.sum("n").alias("times")).where("times > 1").select("whole")
    ranges = (
        compared.where("whole IS NULL")
        .unionByName(many.where("n = 1").join(often, "whole"))
        .groupBy("gram", "span")
        .agg(F.collect_list(F.struct("from", "to")).alias("ranges"))  # the windows of one span
    )
    copies = shared.where("n > 1").select(
        "gram", "span", F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("last") - F.col("first")).alias("to"))).alias("ranges")
    )
    found = (
        _anchor_rows(rows, kind, window, gram, collapse=False)
        .join(copies.unionByName(ranges), ["gram", "span"])
        .withColumn("range", F.explode("ranges"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(  # of one text
                F.struct(
                    (F.col("first") + F.col("range.from")).alias("from"),
                    (F.col("first") + F.col("range.to") + window).alias("to"),
                )
            ).alias("removed")
        )
    )
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.text_hash") == F.col("f.text_hash"))
    return texts.alias("t").join(found.alias("f"), same, "left").select("t.doc_id", "t.text_hash", "t.body", "f.removed")


def kept_parts(raw: bytes, removed: list[dict] | None) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Maximal removed ranges and the bytes between them."""
    cuts = covered([(r["from"], r["to"]) for r in removed or []])
    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
    return cuts, [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]


def kept_texts(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes), ``kept_sha256`` per row of :func:`repeated_bytes`."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for body, removed in zip(batch.column("body"), batch.column("removed")):
                raw = press.decompress(body.as_py())
                cuts, parts = kept_parts(raw, removed.as_py())
                kept = b"".join(parts)
                for name, value in zip(out, (len(raw), len(raw) - len(kept), len(cuts), kept, hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{k: pa.array(v, pa.binary() if k == "kept" else pa.string() if k == "kept_sha256" else pa.int64())
                   for k, v in out.items()},
            })

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return found.mapInArrow(rebuild, schema)
