"""Packing documents into training sequences: a swap-based local search.

Documents are tokenized and cut into pieces of at most one sequence. Pieces are
dealt into bundles of bounded size by a hash. A bundle starts as next fit leaves it;
then items are exchanged one for one, two for one, or moved between underfull bins.
Every step makes a fuller bin fuller, so the sum of squared fills rises until bins
run empty.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import packed, whole
from actlens.session import materialize

SIZE = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
# Pieces per bundle: what one task packs at a time. A bundle wastes about one bin,
# which is 0.03 % of a few thousand.
BUNDLE = 8192
# Words whose ids a worker remembers, across tasks.
MEMORY = 1_000_000

# Printable ASCII and the letters of Latin-1, and how the packaged tokenizer cuts a part of
# these alone: normalizing it is lower-casing it.
LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
NOTHING = re.compile(r"(?!)").fullmatch
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
# The model's characters for bytes that print nothing.
SYMBOLS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class Known(dict):
    """Ids of parts of texts; a part asked for the first time is taken from ``before``, or else learnt."""

    def __init__(self, learn: Callable[[bytes], bytes], before: dict[bytes, bytes]):
        super().__init__({b"": b""})
        self.learn, self.before = learn, before

    def __missing__(self, part: bytes) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = self.learn(part)
        self[part] = ids
        return ids


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never looks across it, so a text is the
    sum of its parts between blanks and line ends; the ids of a part are kept.
    The packaged tokenizer cuts Latin parts as ``CUT`` does, so their cuts go
    straight to its model; all other parts pass its normalizer and pre-tokenizer.
    """

    def __init__(self, path: str | None, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.latin = LATIN if path is None else NOTHING
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = memory
        self.known = Known(self.learn, {})

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:  # else the case of a control token would change
            raw = raw.lower()  # A-Z, which the tokenizer lower-cases itself
        parts = raw.replace(b"\n", b" ").split(b" ")
        if 2 * (len(self.known) + len(parts)) > self.memory:  # the other half is what was known before
            self.known.before = {}
            self.known = Known(self.learn, self.known)
        return b"".join(map(self.known.__getitem__, parts))

    def learn(self, part: bytes) -> bytes:
        word = part.decode()
        if not self.latin(word) or "<|" in word:
            return array("I", self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()
        if not (part.isalpha() and part.islower()):
            cuts = CUT(word.lower())
            if cuts != [word]:
                return b"".join([self.known[cut.encode()] for cut in cuts])
            word = part.decode("latin-1").translate(SYMBOLS)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str | None) -> WordIds:
    """One per worker process and tokenizer file."""
    return WordIds(path)


def token_pieces(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    size: int = SIZE,
    end: int = END,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids`` as bytes) per piece.

    A document is its token ids and then ``end``; only longer ones are cut, into
    pieces of ``size``. ``tokenizer`` is the path of a tokenizer file that every
    executor can read. A null or empty text is one piece that holds ``end`` alone.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    closing = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            owner, places, starts, lengths, sums, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = ids_of(text.as_py()) + closing
                for piece, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    owner.append(i)
                    places.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = {
                "doc_id": batch.column(0).take(pa.array(owner, pa.int64())),
                "piece": pa.array(places, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    rows = packed(docs).select(F.col(f"row.{id}").alias("doc_id"), whole(F.col(f"row.{text}")).alias("text"))
    return rows.mapInArrow(cut, schema)


def next_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item into the last bin, or a new one if it has no room: (bin of item, free of bin)."""
    bin_of = np.empty(len(lengths), np.int64)
    free: list[int] = []
    for i, need in enumerate(lengths.tolist()):
        if not free or free[-1] < need:
            free.append(size)
        free[-1] -= need
        bin_of[i] = len(free) - 1
    return bin_of, np.array(free, np.int64)


class SwapSearch:
    """Local search on a packing; ``run`` empties bins until the lower bound or a local optimum."""

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray, free: np.ndarray, size: int):
        self.lengths, self.bin_of, self.free, self.size = lengths, bin_of, free, size
        self.least = -(-int(lengths.sum()) // size)

    def bins(self) -> int:
        return int((self.free < self.size).sum())

    def run(self) -> None:
        bins = self.bins()
        stuck = np.zeros(len(self.free), bool)
        changed = False  # since the stuck bins were last tried
        while bins > self.least:
            open_bins = np.where(stuck | (self.free == self.size), 0, self.free)
            victim = int(open_bins.argmax())
            before = int(self.free[victim])
            if not open_bins[victim]:
                if not changed:
                    return
                stuck[:], changed = False, False
            elif self.empty(victim):
                bins -= 1
                stuck[:], changed = False, False
            elif self.free[victim] == before:
                stuck[victim] = True
            else:  # the next round goes on with it
                changed = True

    def empty(self, victim: int) -> bool:
        """Take what can be taken out of ``victim``; true if nothing is left in it."""
        while True:
            items = np.flatnonzero(self.bin_of == victim)
            if not len(items):
                return True
            # Equal lengths are alike, and a bin has few different ones, however many items.
            items = self.copies(items, 2)
            items = items[np.argsort(-self.lengths[items], kind="stable")]
            if not (self.move(victim, items) or self.swap(victim, items) or self.swap_two(victim, items)):
                return False

    def shift(self, items: Iterable[int], to: int) -> None:
        for i in items:
            self.free[self.bin_of[i]] += self.lengths[i]
            self.free[to] -= self.lengths[i]
            self.bin_of[i] = to

    def copies(self, items: np.ndarray, most: int) -> np.ndarray:
        """At most so many items of one length and bin, ordered by bin."""
        key = self.bin_of[items] * (self.size + 1) + self.lengths[items]
        order = np.argsort(key, kind="stable")
        key = key[order]
        keep = np.ones(len(key), bool)
        keep[most:] = key[most:] != key[:-most]
        return items[order[keep]]

    def others(self, victim: int) -> np.ndarray:
        """Items of the other underfull bins."""
        room = self.free[self.bin_of]
        return np.flatnonzero((room > 0) & (self.bin_of != victim))

    def move(self, victim: int, items: np.ndarray) -> bool:
        """An item into the bin with the least room that takes it, and is fuller with it than the victim was."""
        room = np.where(self.free < self.size, self.free, 0)
        room[victim] = 0
        for i in items:
            fits = np.flatnonzero((room >= self.lengths[i]) & (room < self.free[victim] + self.lengths[i]))
            if len(fits):
                self.shift([i], int(fits[room[fits].argmin()]))
                return True
        return False

    def swap(self, victim: int, items: np.ndarray) -> bool:
        """An item for a shorter one of a fuller bin that has room for the difference."""
        others = self.others(victim)
        others = others[self.free[self.bin_of[others]] <= self.free[victim]]
        room = self.free[self.bin_of[others]]
        for i in items:
            gain = self.lengths[i] - self.lengths[others]
            fits = (gain > 0) & (gain <= room)
            if fits.any():
                j = int(others[np.where(fits, gain, 0).argmax()])
                to = int(self.bin_of[j])
                self.shift([i], to)
                self.shift([j], victim)
                return True
        return False

    def swap_two(self, victim: int, items: np.ndarray) -> bool:
        """Two items for one, in either direction, where a fuller bin gains."""
        others = self.others(victim)
        others = others[self.free[self.bin_of[others]] <= self.free[victim]]
        room = self.free[self.bin_of[others]]
        for n, i in enumerate(items):
            for j in items[n + 1 :]:
                gain = self.lengths[i] + self.lengths[j] - self.lengths[others]
                fits = (gain > 0) & (gain <= room)
                if fits.any():
                    k = int(others[np.where(fits, gain, 0).argmax()])
                    to = int(self.bin_of[k])
                    self.shift([i, j], to)
                    self.shift([k], victim)
                    return True
        order = self.copies(others, 2)
        owners = self.bin_of[order]
        for apart in range(1, len(order)):
            same = np.flatnonzero(owners[apart:] == owners[:-apart])
            if not len(same):
                break
            a, b = order[same], order[same + apart]
            pair, pair_room = self.lengths[a] + self.lengths[b], self.free[self.bin_of[a]]
            for i in items:
                gain = self.lengths[i] - pair
                fits = (gain > 0) & (gain <= pair_room)
                if fits.any():
                    k = int(np.where(fits, gain, 0).argmax())
                    to = int(self.bin_of[a[k]])
                    self.shift([i], to)
                    self.shift([a[k], b[k]], victim)
                    return True
        return False


def pack_lengths(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item: next fit in the given order, then the search.

    Items of full size get bins of their own and take no part in it.
    """
    lengths = np.asarray(lengths, np.int64)
    out = np.empty(len(lengths), np.int64)
    full = lengths >= size
    out[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    if len(rest):
        search = SwapSearch(lengths[rest], *next_fit(lengths[rest], size), size)
        search.run()
        out[rest] = full.sum() + np.unique(search.bin_of, return_inverse=True)[1]
    return out


def pack(pieces: DataFrame, size: int = SIZE, bundle: int = BUNDLE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces as made by :func:`token_pieces`, stored by the caller.

    A bundle holds about ``bundle`` pieces, drawn by hash of the row, whatever a document's or a
    group's share of them.
    """
    n = pieces.count()
    bundles = max(1, -(-n // bundle))
    # By row, not by content: repeated rows must not meet in one bundle. The stored
    # pieces are read in the same order again if a task is lost.
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(bundles)).cast("int")
    schema = f"{_ddl(pieces)}, sequence_id long, offset long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ids_crc32", "length", "doc_id", "piece"], kind="stable")  # the same after a lost task
        rows["bin"] = pack_lengths(rows["length"].to_numpy(), size)
        rows = rows.sort_values(["bin"], kind="stable")
        offset = rows.groupby("bin")["length"].cumsum() - rows["length"]
        rows["sequence_id"] = rows["bundle"].astype("int64") * (1 << 32) + rows["bin"]
        rows["offset"] = offset
        return rows.drop(columns=["bin", "bundle"])

    return pieces.withColumn("bundle", key).groupBy("bundle").applyInPandas(one, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def packed_pieces(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SIZE, **options) -> DataFrame:
    """Where every piece of every document goes.

    * Null and empty texts are documents of one token; they are packed like others.
    * Repeated rows are packed as often as they occur; null ids are kept.
    * An empty table gives an empty result. Other columns are not read.
    """
    return pack(materialize(token_pieces(docs, text, id, size, **options), "pieces"), size)


def sequences(placed: DataFrame) -> DataFrame:
    """The token sequences (``sequence_id``, ``ids`` as bytes) of placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence at most
    joined = F.aggregate(parts, F.lit(b""), lambda all, part: F.concat(all, part["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
