"""Repeated word passages by a relative Lempel-Ziv parse.

Each document is factored against the documents with smaller ids. Its words are cut
into blocks at content-defined places: a window of words hangs on the phrase in it with
the smallest hash, and the windows on one phrase make a block. So whatever two documents
share, they share as equal windows on equal phrases, and a block meets all reference
blocks that can hold a part of it by its phrase alone:

1. index: all blocks, ranged by (phrase, document) over the partitions;
2. a block that a smaller document holds whole is copied from there in one piece;
3. at the boundaries of factors, where the phrase is known but the block is not, single
   windows are looked up among the windows of the reference blocks of that phrase;
4. parse: pieces on one line of one source document are chained, and factors are taken
   greedily from left to right, always the one that reaches farthest.

A factor is at least one window long and is a duplicate span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import packed, whole
from actlens.llm.repeat_windows import Hashes, sliding_argmin
from actlens.llm.word_hash import mix, text_words
from actlens.session import materialize

WINDOW = 13
PHRASE = 5
# Windows hashed at a time, and index rows that a task holds at a time.
PART = 1 << 20
HELD = 1 << 16
_COPIED, _OPEN, _BORDER = 0, 1, 2


def _marks(hashes: Hashes, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Hash of all words of ``n`` neighbouring windows."""
    return mix(hashes.of(first, first + n + window - 1) ^ n.astype(np.uint64))


def blocks(words: np.ndarray, owner: np.ndarray, window: int, phrase: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(phrase hash, block hash, first word, windows) of the blocks of neighbouring texts.

    ``owner`` tells each word's text; no window crosses texts.
    """
    for at in range(0, max(len(words) - window + 1, 0), PART):
        part = words[at : at + PART + window - 1]
        hashes = Hashes(part)
        grams = hashes.all(phrase)
        place = sliding_argmin(grams, window - phrase + 1)
        mine = owner[at : at + len(part)]
        inside = np.flatnonzero(mine[: len(place)] == mine[window - 1 :])
        if not len(inside):
            continue
        here = place[inside]
        head = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        first, n = inside[head], np.diff(np.append(head, len(inside)))
        yield grams[here[head]].view(np.int64), _marks(hashes, first, n, window).view(np.int64), first + at, n


def _batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each word's text, and where each text begins."""
    found = list(text_words(texts))
    sizes = np.array([len(h) for h in found], np.int64)
    words = np.concatenate([np.zeros(0, np.uint64), *found])
    return words, np.repeat(np.arange(len(found)), sizes), np.cumsum(sizes) - sizes


def _texts(docs: DataFrame, text: str, id: str) -> DataFrame:
    """``id``, ``tie`` and ``text``; rows without an id are told apart by a hash of the text."""
    body, key = whole(F.col(f"row.{text}")), F.col(f"row.{id}")
    tie = F.when(key.isNull(), F.xxhash64(body)).otherwise(F.lit(0).cast("long"))
    return packed(docs).select(key.alias("id"), tie.alias("tie"), body.cast("binary").alias("text"))


def _index(texts: DataFrame, kind: str, window: int, phrase: int) -> DataFrame:
    """``phrase``, ``block``, ``id``, ``tie``, ``at`` (first word * 256 + windows) of every block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner, begin = _batch_words(batch.column("text").to_pylist())
            for gram, block, first, n in blocks(words, owner, window, phrase):
                who = owner[first]
                yield pa.RecordBatch.from_pydict({
                    "phrase": pa.array(gram), "block": pa.array(block),
                    "id": batch.column("id").take(pa.array(who)), "tie": batch.column("tie").take(pa.array(who)),
                    "at": pa.array(((first - begin[who]) << 8) | n),
                })

    return texts.mapInArrow(find, f"phrase long, block long, id {kind}, tie long, at long")


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _settle_phrases(rows: pa.Table, entire: bool) -> pa.Table:
    """Phrases sorted by (phrase, id): copied blocks with their sources, and open blocks.

    Where the phrases are not ``entire``, a copied block has a smaller document among these rows,
    and what leads among equal blocks is a border row: only those wait for other rows.
    """
    gram, block = rows.column("phrase").to_numpy(), rows.column("block").to_numpy()
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    group = np.cumsum(new) - 1
    person = np.cumsum(new | _changes(rows.column("id").combine_chunks()))
    order = np.lexsort((block, group))  # stable: the smallest id leads among equal blocks
    b, g = block[order], group[order]
    head = np.concatenate([[True], (b[1:] != b[:-1]) | (g[1:] != g[:-1])])
    source = np.empty(len(gram), np.int64)
    source[order] = order[head][np.cumsum(head) - 1]
    copied = person[source] != person
    kept = np.arange(len(gram))
    if entire:
        kinds = np.bincount(g[head])
        at = np.flatnonzero(new)
        people = person[np.append(at[1:], len(gram)) - 1] - person[at]
        kept = np.flatnonzero(copied | ((kinds > 1) & (people > 0))[group])
    mine, theirs = rows.take(pa.array(kept)), rows.take(pa.array(source[kept]))
    state = np.where(copied[kept], _COPIED, _OPEN if entire else _BORDER)
    columns = {name: mine.column(name) for name in ("phrase", "block", "id", "tie", "at")}
    return pa.table(
        {"state": pa.array(state, pa.int32()), **columns, "source": theirs.column("id"), "source_at": theirs.column("at")}
    )


def _settled(index: DataFrame, kind: str, held: int) -> DataFrame:
    """The blocks of the index that any other document has to do with.

    ``state`` 0: the block stands whole in the smaller document ``source`` at ``source_at``.
    1: no smaller document has it, but several documents have its phrase. 2: the phrase
    may go on in a neighbouring partition, or has more rows than a task holds, and none
    of these rows has the block in a smaller document.

    Ranges are cut by (phrase, id), so a phrase in a third of all documents is
    spread over partitions, and a task reads its rows as a stream.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = large = None

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.combine_chunks().to_batches()

        def border(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from out(_settle_phrases(table, entire=False))

        def inner(table: pa.Table) -> Iterator[pa.RecordBatch]:
            gram = table.column("phrase").to_numpy()
            open_ = gram == edge
            if large is not None:
                open_ |= gram == large
            if open_.any():
                yield from border(table.filter(pa.array(open_)))
                table = table.filter(pa.array(~open_))
            if len(table):
                yield from out(_settle_phrases(table, entire=True))

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < held:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            gram = table.column("phrase").to_numpy()
            edge = gram[0] if edge is None else edge
            cut = int(np.searchsorted(gram, gram[-1]))  # the last phrase may go on
            if cut:
                yield from inner(table.slice(0, cut))
                waiting, rows = table.slice(cut).to_batches(), len(table) - cut
            else:
                large = gram[-1]
                yield from border(table)
                waiting, rows = [], 0
        if rows:
            table = pa.Table.from_batches(waiting).combine_chunks()
            gram = table.column("phrase").to_numpy()
            edge = gram[0] if edge is None else edge
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield from inner(table.slice(0, cut))
            yield from border(table.slice(cut))

    order = ["phrase", F.col("id").isNull(), "id"]
    ranged = index.repartitionByRange(*order).sortWithinPartitions(*order, "tie", "at")
    return ranged.mapInArrow(
        settle, f"state int, phrase long, block long, id {kind}, tie long, at long, source {kind}, source_at long"
    )


def _squeezed(texts: DataFrame, kind: str) -> DataFrame:
    """The texts as compressed bytes, for the shuffles that move them."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), body], ["id", "tie", "body"])

    return texts.mapInArrow(squeeze, f"id {kind}, tie long, body binary")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))


def _smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest document with each key, and whether others have it; combined in the map tasks."""
    who = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"))
    where = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("at").alias("at"))
    return rows.groupBy(*keys).agg(F.min(where).alias("least"), F.max(who).alias("most"))


def _open_windows(squeezed: DataFrame, opened: DataFrame, kind: str, window: int) -> DataFrame:
    """``phrase``, ``mark``, ``id``, ``tie``, ``at`` of every window of the open blocks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            words, _, begin = _batch_words([press.decompress(b) for b in batch.column("body").to_pylist()])
            asked = batch.column("asked")
            who = pc.list_parent_indices(asked).to_numpy()
            flat = pc.list_flatten(asked)
            gram, block, at = (flat.field(k).to_numpy() for k in range(3))
            first, n = begin[who] + (at >> 8), at & 255
            hashes = Hashes(words)
            # Rows with one id may have several texts; a block belongs to those that hold it there.
            inside = np.flatnonzero(first + n + window - 1 <= np.append(begin[1:], len(words))[who])
            mine = inside[_marks(hashes, first[inside], n[inside], window).view(np.int64) == block[inside]]
            copy = np.repeat(mine, n[mine])
            step = np.arange(len(copy)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            here = first[copy] + step
            one = np.ones(len(copy), np.int64)
            yield pa.RecordBatch.from_pydict({
                "phrase": pa.array(gram[copy]), "mark": pa.array(_marks(hashes, here, one, window).view(np.int64)),
                "id": batch.column("id").take(pa.array(who[copy])), "tie": batch.column("tie").take(pa.array(who[copy])),
                "at": pa.array(((here - begin[who[copy]]) << 8) | 1),
            })

    asked = opened.groupBy("id", "tie").agg(  # blocks of one document
        F.collect_set(F.struct("phrase", "block", "at")).alias("asked")
    )
    rows = squeezed.alias("t").join(asked.alias("a"), _same_row("t", "a")).select("t.id", "t.tie", "t.body", "a.asked")
    return rows.mapInArrow(look, f"phrase long, mark long, id {kind}, tie long, at long")


def factors(
    docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, phrase: int = PHRASE, held: int = HELD
) -> DataFrame:
    """``id``, ``tie``, ``body`` (compressed text) and ``pieces`` of every row.

    ``pieces`` are the copies from smaller documents that a parse starts from: ``at`` (first word * 256
    + windows), ``mark`` (hash of the words), ``source``, ``source_at``; null where there are none.
    """
    kind = docs.schema[id].dataType.simpleString()
    texts = _texts(docs, text, id)
    squeezed = _squeezed(texts, kind)
    settled = materialize(_settled(_index(texts, kind, window, phrase), kind, held), "blocks")
    plain = ["phrase", "block", "id", "tie", "at"]
    copy = ["id", "tie", "at", "mark", "source", "source_at"]
    mine = F.col("id").eqNullSafe(F.col("least.id"))

    def copied(rows: DataFrame) -> DataFrame:
        found = rows.where(~mine)
        return found.withColumns({"source": F.col("least.id"), "source_at": F.col("least.at")}).select(*copy)

    border = settled.where(f"state = {_BORDER}").select(*plain)
    known = border.join(_smallest(border, ["phrase", "block"]), ["phrase", "block"])
    opened = settled.where(f"state = {_OPEN}").select(*plain).unionByName(known.where(mine).select(*plain))
    windows = materialize(_open_windows(squeezed, opened, kind, window), "windows")
    shared = _smallest(windows, ["phrase", "mark"]).where("NOT (least.id <=> most.id)").drop("most")
    pieces = (
        settled.where(f"state = {_COPIED}").withColumnRenamed("block", "mark").select(*copy)
        .unionByName(copied(known.withColumnRenamed("block", "mark")))
        .unionByName(copied(windows.join(shared, ["phrase", "mark"])))
        .groupBy("id", "tie")
        .agg(F.collect_set(F.struct("at", "mark", "source", F.shiftright("source_at", 8).alias("source_at"))).alias("pieces"))
    )
    return squeezed.alias("t").join(pieces.alias("p"), _same_row("t", "p"), "left").select("t.id", "t.tie", "t.body", "p.pieces")


def parse(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, line) of matches sorted by start: from each word the one that reaches farthest.

    Factors do not overlap; each lies in a match. ``line`` is the distance to the place in the source.
    """
    out: list[tuple[int, int, int, int]] = []
    i, here, best = 0, -1, (-1, -1, -1, -1)
    while True:
        while i < len(runs) and runs[i][0] <= here:
            best = max(best, runs[i], key=lambda r: r[1])
            i += 1
        if best[1] > here:
            out.append((here, best[1], best[2], best[3]))
            here = best[1]
        elif i < len(runs):
            here = runs[i][0]
        else:
            return out


def _chained(owner, first, end, source, line) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(text, matches): pieces that overlap on one line of one source, joined."""
    order = np.lexsort((first, line, source, owner))
    owner, first, end, source, line = (x[order] for x in (owner, first, end, source, line))
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(source) != 0) | (np.diff(line) != 0)])
    lane = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lane)
    head = np.flatnonzero(np.concatenate([[True], first[1:] + lane[1:] > reach[:-1]]))
    last = (reach - lane)[np.append(head[1:], len(first)) - 1]
    owner, first, source, line = (x[head] for x in (owner, first, source, line))
    order = np.lexsort((-last, first, owner))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) != 0]))
    rows = np.stack([first, last, source, line], axis=1)[order].tolist()
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(owner[order[a]]), [tuple(r) for r in rows[a:b]]


def kept_words(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``factors``, ``kept``, ``kept_sha256`` per row of :func:`factors`.

    ``factors`` lists the parse: ``start`` and ``length`` in words, the ``source`` document and
    ``source_start`` there; ``kept`` are the other words, joined by one space (UTF-8).
    """
    kind = found.schema["id"].dataType.simpleString()
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            raws = [press.decompress(b) for b in batch.column("body").to_pylist()]
            parsed: dict[int, list] = {}
            pieces = batch.column("pieces")
            who = pc.list_parent_indices(pieces).to_numpy()
            flat = pc.list_flatten(pieces)
            if len(flat):
                some = np.unique(who)
                words, _, begin = _batch_words([raws[i] for i in some])
                at, mark, start_there = (flat.field(k).to_numpy() for k in (0, 1, 3))
                source = flat.field(2).dictionary_encode()
                mine = np.searchsorted(some, who)
                first, n = at >> 8, at & 255
                here = begin[mine] + first
                inside = np.flatnonzero(here + n + window - 1 <= np.append(begin[1:], len(words))[mine])
                marks = _marks(Hashes(words), here[inside], n[inside], window).view(np.int64)
                ok = inside[marks == mark[inside]]
                if len(ok):
                    codes = source.indices.to_numpy()[ok]
                    end = first[ok] + n[ok] + window - 1
                    for i, runs in _chained(who[ok], first[ok], end, codes, start_there[ok] - first[ok]):
                        parsed[i] = parse(runs)
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept", "kept_sha256", "factors")}
            for i, raw in enumerate(raws):
                words = raw.split()
                cuts = parsed.get(i, [])
                edges = [0, *(x for a, b, _, _ in cuts for x in (a, b)), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept = b" ".join(left)
                made = [{"start": a, "length": b - a, "source": s, "source_start": a + d} for a, b, s, d in cuts]
                for name, value in zip(out, (len(words), len(words) - len(left), kept, hashlib.sha256(kept).hexdigest(), made)):
                    out[name].append(value)
            made = pa.array(out["factors"], pa.list_(shape))
            fields = made.values.flatten()
            if len(fields[2]):
                fields[2] = source.dictionary.take(fields[2])
            else:
                fields[2] = pa.nulls(0, batch.column("id").type)
            struct = pa.StructArray.from_arrays(fields, ["start", "length", "source", "source_start"])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"),
                "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                "factors": pa.ListArray.from_arrays(made.offsets, struct),
                "kept": pa.array(out["kept"], pa.binary()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            })

    made = f"array<struct<start: long, length: long, source: {kind}, source_start: long>>"
    schema = f"id {kind}, n_words long, n_removed long, factors {made}, kept binary, kept_sha256 string"
    return found.mapInArrow(rebuild, schema)


def repeated_passages(
    docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, phrase: int = PHRASE, held: int = HELD
) -> DataFrame:
    """What is left of every text without passages that a document with a smaller id has too.

    Columns as in :func:`kept_words`, one row per row of ``docs``. Words are runs of bytes other than
    ASCII white space. A word goes if one of the windows of ``window`` words over it also starts in a
    document with a smaller id; windows are judged on the input, not on what is left.

    * A null or empty text has no words; a text shorter than a window loses nothing.
    * Rows with equal ids are one document: they repeat smaller ones, never each other.
    * A null id is greater than all others; rows without an id do not repeat each other.
    * Equal texts: all but the smallest id lose every window. An empty table gives an empty result.
    * Very long texts are hashed in parts. Other columns are not read.

    Words, phrases and blocks are known by 64-bit hashes; equal windows agree in two of them.
    """
    return kept_words(factors(docs, text, id, window, phrase, held), window)
