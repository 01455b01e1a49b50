"""Language-model scores from a log-bilinear model, trained by noise-contrastive estimation.

Token counts come from all training texts. The most frequent tokens and one rest
class are the outcomes of the neural model: each of the two tokens before has a
vector per place, their sum predicts the vector of the outcome. Each partition
trains on its texts in numpy from the same start; the parameters are averaged by
tokens. Every other training word has context vectors of its own, added to those of
the rest class, and a place in a tree of log-bilinear choices below that class (see
``word_tree``), so all known words are predicted and conditioned on as themselves and
token log-probabilities are exact. Words of the dictionary are known to every worker;
the others get their vectors and their share of the tree by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import packed, whole
from actlens.llm.word_tree import NONE, OUTSIDE, Newton, Sums, Tree, context_outcome, occurrences, sums_by_place
from actlens.session import materialize

END = b""  # no word is empty
# Fixed bounds: outcomes of the neural model, and words whose vectors every worker knows.
# Other words are met by joins; their tables grow with the distinct words.
OUTCOMES = 1024
DICTIONARY = 200_000
WIDTH = 16
NOISE = 32
BATCH = 4096
FLUSH = 400_000
# Tokens of texts that are scored together.
CHUNK = 200_000
# Most frequent words whose pairs have their normalisers in a worker's table (64 MB).
PAIRS = 4096
# Words outside the dictionary that share a task's tree, on average; the trees grow in number.
STEM = 4096


def is_held_out(id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 7 == 2


def tokens_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end token."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` all texts without their end tokens, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # a text may begin or end with blanks
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]
    return words.filter(real).cast(pa.binary()), np.diff(before)


def values_of(column: pa.Array) -> list[bytes]:
    """``to_pylist`` without a scalar per value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def binary_rows(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(0, size * len(rows) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


@dataclass
class Shape:
    """Sizes of the parameter arrays and their places in one flat vector."""

    outcomes: int
    width: int

    def split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the last token, of the one before, of the outcomes, and their constants."""
        k, d = self.outcomes, self.width
        ends = np.cumsum([(k + 1) * d, (k + 1) * d, k * d])
        one, two, out, bias = np.split(flat, ends)
        return one.reshape(k + 1, d), two.reshape(k + 1, d), out.reshape(k, d), bias

    def start(self, share: np.ndarray, seed: int) -> np.ndarray:
        """Small vectors and the log shares as constants: at first the model is the unigram."""
        k, d = self.outcomes, self.width
        vectors = np.random.default_rng(seed).normal(0, 0.1, (3 * k + 2) * d)
        return np.concatenate([vectors, np.log(share)]).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with Adagrad steps and noise shared by a batch."""

    def __init__(self, shape: Shape, flat: np.ndarray, share: np.ndarray, noise: int, rate: float, seed: int):
        self.flat = flat.copy()
        self.one, self.two, self.out, self.bias = shape.split(self.flat)
        self.steps = [np.full(a.shape, 0.1, np.float32) for a in (self.one, self.two, self.out, self.bias)]
        self.noise, self.rate = noise, rate
        self.kind = np.uint16 if shape.outcomes < 1 << 16 else np.int64
        self.log_noise = np.log(noise * share).astype(np.float32)
        self.cdf = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def step(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> None:
        drawn = np.searchsorted(self.cdf, self.rng.random(self.noise) * self.cdf[-1]).clip(0, len(self.cdf) - 1)
        guess = self.one[last] + self.two[before]
        target, noise = self.out[outcome], self.out[drawn]
        right = (guess * target).sum(1) + self.bias[outcome] - self.log_noise[outcome]
        wrong = guess @ noise.T + (self.bias[drawn] - self.log_noise[drawn])
        pull = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
        to_guess = pull[:, None] * target + push @ noise
        to_out = np.concatenate([pull[:, None] * guess, push.T @ guess])
        outcomes = np.concatenate([outcome, drawn])
        scale = np.float32(1 / len(outcome))
        for array, past, rows, grad in (
            (self.one, self.steps[0], last, to_guess),
            (self.two, self.steps[1], before, to_guess),
            (self.out, self.steps[2], outcomes, to_out),
            (self.bias, self.steps[3], outcomes, np.concatenate([pull, push.sum(0)])),
        ):
            rows = rows.astype(self.kind)  # numbers of 16 bits are sorted by their digits
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
            ids = rows[first]
            total = np.add.reduceat(grad[order], first, axis=0) * scale
            past[ids] += total * total
            array[ids] += self.rate * total / np.sqrt(past[ids])
        self.seen += len(outcome)


@dataclass
class Model:
    """Tables for scoring: logit parts per (last, outcome) and (before, outcome), and log normalisers."""

    near: np.ndarray
    far: np.ndarray
    log_z: np.ndarray

    @staticmethod
    def of(shape: Shape, flat: np.ndarray) -> Model:
        one, two, out, bias = (a.astype(np.float64) for a in shape.split(flat))
        near, far = one @ out.T, two @ out.T + bias
        near_top, far_top = near.max(1, keepdims=True), far.max(1, keepdims=True)
        z = np.exp(near - near_top) @ np.exp(far - far_top).T
        log_z = np.log(z) + near_top + far_top.T
        return Model(*(a.astype(np.float32) for a in (near, far, log_z)))

    def log_prob(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Natural log probability of each outcome after its context."""
        return self.near[last, outcome].astype(np.float64) + self.far[before, outcome] - self.log_z[last, before]


@dataclass
class Vocabulary:
    """The dictionary in order of frequency; the first ``outcomes - 1`` words are outcomes, the last outcome is the rest."""

    words: list[bytes]
    counts: np.ndarray
    outcomes: int
    train_tokens: int
    distinct: int

    def shares(self) -> np.ndarray:
        top = self.counts[: self.outcomes - 1].astype(float)
        rest = max(self.train_tokens - top.sum(), 0)
        counts = np.append(top, rest) + 1
        return counts / counts.sum()

    def rest_total(self) -> float:
        """Counts in the rest class, one added per distinct token and one for unknown tokens."""
        top = self.counts[: self.outcomes - 1]
        return float(self.train_tokens - top.sum() + self.distinct - len(top) + 1)


def count_tokens(rows: DataFrame) -> DataFrame:
    """``word``, ``n`` over all rows (``text``): counted in the map tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(parts: list[pa.Table]) -> pa.Table:
            sums = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = split_words(batch.column("text"))
            values, times = pc.value_counts(found).flatten()
            held.append(pa.table({"word": values, "n": times}))
            held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([len(sizes)], pa.int64())}))
            if sum(map(len, held)) > FLUSH:
                held = [added(held)]
                if len(held[0]) > FLUSH // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from added(held).to_batches()

    return rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, outcomes: int = OUTCOMES, dictionary: int = DICTIONARY) -> Vocabulary:
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Counts in steps of a sixteenth of a doubling: under 1024 rows. The dictionary takes
    # whole steps from the top while they fit, so no task has to rank all words.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    fits = [row["step"] for row, total in zip(steps, np.cumsum([r["count"] for r in steps])) if total <= dictionary]
    top = counts.where(step >= (fits[-1] if fits else 1 << 30)).toArrow()  # `dictionary` rows at most
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().copy()
    return Vocabulary(words, n, min(outcomes, len(words) + 1), sums["n"] or 0, sums["v"])


def contexts(places: np.ndarray, outcomes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, before, outcome) per token; the place before a text is a context of its own."""
    rest = outcomes - 1
    outcome = np.where((places < 0) | (places > rest), rest, places)
    padded = np.concatenate([[outcomes, outcomes], outcome])
    return padded[1:-1], padded[:-2], outcome


def pack_places(places: np.ndarray) -> bytes:
    """Places (-1: not in the dictionary) as planes of bytes, of which all but two are nearly empty."""
    return (places + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_places(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64) - 1


def pack_words(words: list[bytes]) -> bytes:
    raw = b"".join(w + b" " for w in words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).split(b" ")[:-1]


def rare_words(raw: bytes, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Where words outside the dictionary stand, and which; no word holds a blank."""
    at = np.flatnonzero(places < 0)
    return at, raw.split(b" ") if len(at) else []


def encoded(rows: DataFrame, known) -> DataFrame:
    """The other columns with ``places`` in the dictionary and the other words, ``rare``, instead of ``text``."""
    others = [c for c in rows.columns if c != "text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(known.value)}
        end = place.get(END, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = split_words(batch.column("text"))
            found = found.dictionary_encode()
            distinct = values_of(found.dictionary)
            at = found.indices.to_numpy()
            all_ = np.fromiter(map(place.get, distinct, repeat(-1)), np.int64, len(distinct))[at]
            packed_, rare = [], []
            for places, mine in zip(np.split(all_, np.cumsum(sizes)[:-1]), np.split(at, np.cumsum(sizes)[:-1])):
                others_ = [distinct[i] for i in mine[places < 0].tolist()]
                packed_.append(pack_places(np.append(places, end)))
                rare.append(b" ".join(others_ if end >= 0 else [*others_, END]))
            columns = [*(batch.column(c) for c in others), pa.array(packed_, pa.binary()), pa.array(rare, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "places", "rare"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(encode, f"{kinds}, places binary, rare binary")


def train(rows: DataFrame, shape: Shape, share: np.ndarray, rate: float = 0.5, seed: int = 42) -> np.ndarray:
    """Parameters after one pass of every partition over its rows, averaged by tokens."""
    start = shape.start(share, seed)
    kept = rows.sparkSession.sparkContext.broadcast(start)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shape, kept.value, share, NOISE, rate, seed)
        held, n = [], 0

        def feed(least: int):
            nonlocal held, n
            columns = [np.concatenate(c) for c in zip(*held)]
            while len(columns[0]) >= least and len(columns[0]):
                trainer.step(*(c[:BATCH] for c in columns))
                columns = [c[BATCH:] for c in columns]
            held, n = ([columns], len(columns[0])) if len(columns[0]) else ([], 0)

        for batch in batches:
            for raw in batch.column("places"):
                held.append(contexts(unpack_places(raw.as_py()), shape.outcomes))
                n += len(held[-1][0])
                if n >= 16 * BATCH:
                    feed(BATCH)
        if held:
            feed(1)
        if trainer.seen:
            yield pa.RecordBatch.from_pydict(
                {"params": pa.array([trainer.flat.tolist()], pa.list_(pa.float32())), "weight": pa.array([float(trainer.seen)])}
            )

    trained = rows.select("places").mapInArrow(fit, "params array<float>, weight double")
    mean = (
        trained.select("weight", F.posexplode("params").alias("at", "value"))
        .groupBy("at")
        .agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    )
    averaged = mean.toArrow()  # the model's size, whatever the corpus
    flat = start.copy()
    flat[averaged.column("at").to_numpy()] = averaged.column("mean").to_numpy()
    return flat


# A word outside the dictionary: its number in its stem, its place, the places around it.
COLUMNS = ("leaf", "at", "pos", "learnt", "m2", "m1", "p1", "p2")


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Integers as planes of bytes, most of them empty, compressed; their number stands before."""
    raw = b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_columns(raw: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return {c: np.zeros(0, np.int64) for c in COLUMNS}
    planes = np.frombuffer(pa.decompress(raw[8:], 64 * n, "zstd", asbytes=True), np.uint8).reshape(8, 8, n)
    return {c: np.ascontiguousarray(p.T).view("<i8").ravel() for c, p in zip(COLUMNS, planes)}


def stem_rows(rows: DataFrame, n_stems: int, terms: Sums) -> DataFrame:
    """One row per ``stem`` of words outside the dictionary: ``packed`` occurrences, and what its training words sum up to.

    ``n`` occurrences, ``words`` and ``sums`` are of training texts. An occurrence crosses the network once,
    in a row per stem and flush.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not words:
                return
            columns = np.concatenate(held, 1)
            stems = np.fromiter(map(crc32, words), np.int64, len(words)) % n_stems
            order = np.argsort(stems, kind="stable")
            stems, columns = stems[order], columns[:, order]
            at_ = columns[1].copy()
            columns[1, 1:] = np.diff(at_)
            used, first = np.unique(stems, return_index=True)
            ends = np.append(first[1:], len(stems))
            for at in range(0, len(used), 64):
                cuts = list(zip(first[at : at + 64].tolist(), ends[at : at + 64].tolist()))
                yield pa.RecordBatch.from_pydict({
                    "stem": pa.array(used[at : at + 64], pa.int32()),
                    "spelt": pa.array([pack_words([words[i] for i in order[a:b]]) for a, b in cuts], pa.binary()),
                    "start": pa.array([at_[a] for a, _ in cuts], pa.int64()),
                    "packed": pa.array([pack_columns(list(columns[:, a:b])) for a, b in cuts], pa.binary()),
                })

        for batch in batches:
            for raw, rare, at, out in zip(*(batch.column(c).to_pylist() for c in ("places", "rare", "at", "held_out"))):
                places = unpack_places(raw)
                i, found = rare_words(rare, places)
                if not len(i):
                    continue
                padded = np.concatenate([[NONE, NONE], places, [NONE, NONE]])
                words += found
                zero = np.zeros(len(i), np.int64)
                held.append(np.stack([zero, zero + at, i, zero + (not out), padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]))
                if len(words) > FLUSH:
                    yield from flush()
                    words, held = [], []
        yield from flush()

    def gather(mine: pd.DataFrame) -> pd.DataFrame:
        words: list[bytes] = []
        parts = []
        for spelt, start, packed_ in zip(mine["spelt"], mine["start"], mine["packed"]):
            words += unpack_words(spelt)
            c = unpack_columns(packed_)
            c["at"] = np.cumsum(np.concatenate([[start], c["at"][1:]]))  # a single row is read-only
            parts.append(np.stack([c[x] for x in COLUMNS]))
        columns = np.concatenate(parts, 1)
        number, names = pd.factorize(np.array(words, object), sort=True)
        seen = np.bincount(number[columns[3] == 1], minlength=len(names)) > 0
        columns[0] = np.where(seen, np.cumsum(seen) - 1, -1)[number]  # words never seen in training: -1
        columns = columns[:, np.lexsort((columns[2], columns[1], number))]
        n_words = int(seen.sum())
        times, sums = terms.of_rows(dict(zip(COLUMNS, columns)), n_words)
        total = sums[:, : terms.width].sum(0, dtype=np.float64)
        return pd.DataFrame({
            "stem": [int(mine["stem"].iloc[0])], "n": [float(times.sum())], "words": [n_words],
            "sums": [total.tolist()], "packed": [pack_columns(list(columns))],
        })

    sent = rows.select("places", "rare", "at", "held_out").mapInArrow(collect, "stem int, spelt binary, start long, packed binary")
    return sent.groupBy("stem").applyInPandas(gather, "stem int, n double, words long, sums array<double>, packed binary")


class Scorer:
    """Contexts and log probabilities of tokens, from places in the dictionary, ``OUTSIDE`` or ``NONE``.

    ``pairs``: places below it (and ``NONE``) have the normalisers of all their pairs in a table.
    """

    def __init__(self, shape: Shape, flat: np.ndarray, tree: Tree, own: np.ndarray, centre: np.ndarray, pairs: int = 0):
        self.shape, self.flat, self.pairs = shape, flat, pairs
        self.one, self.two, self.out, self.bias = (a.astype(np.float32) for a in shape.split(flat))
        self.tree, self.own, self.centre = tree, own, centre.astype(np.float32)
        self.rest, self.width = shape.outcomes - 1, shape.width
        # Powers of two are cheaper than those of e.
        self.wide = np.concatenate([self.out, self.bias[:, None]], 1) * np.float32(1 / math.log(2))
        self.most, self.most_bias = np.sqrt((self.out**2).sum(1).max()), np.abs(self.bias).max()

    @cached_property
    def model(self) -> Model:
        """Tables of the outcomes' contexts, made where they are used."""
        return Model.of(self.shape, self.flat)

    @cached_property
    def pair_log_z(self) -> np.ndarray:
        """Log normalisers by (last, before) of frequent places, then of ``NONE``; not a number where a context has to be scored itself.

        exp(near + far) is exp(near) * exp(far), so a table of all pairs is one product of matrices.
        """
        places = np.append(np.arange(self.pairs), NONE)
        last, before = self.context(places, None), self.context(None, places)

        def powers(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = logits.max(1)
            logits -= top[:, None]
            # What lies so far below the top counts for nothing, unless the tops of both lie far apart.
            np.clip(logits, -40, None, out=logits)
            return np.exp(logits, out=logits), top

        far, far_top = powers(before @ self.out.T + self.bias)
        table = np.empty((len(places), len(places)), np.float32)
        for at in range(0, len(places), 256):  # a worker needs little more than the table
            near, near_top = powers(last[at : at + 256] @ self.out.T)
            z = table[at : at + 256]
            np.matmul(near, far.T, out=z)
            z[z < 1e-6] = np.nan
            np.log(z, out=z)
            z += near_top[:, None]
            z += far_top
        return table

    def context(self, last: np.ndarray | None, before: np.ndarray | None) -> np.ndarray:
        """Sum of the vectors of two places (or of one), without own vectors of words outside the dictionary."""
        d, h = self.width, np.float32(0)
        for places, table, half in ((last, self.one, slice(0, d)), (before, self.two, slice(d, 2 * d))):
            if places is not None:
                h = h + table[context_outcome(places, self.rest)]
                i = np.flatnonzero(places >= self.rest)
                h[i] += self.own[places[i] - self.rest, half]
        return h

    def tokens(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``token`` of all places of texts at ``starts``; 0 where the context holds a word outside the dictionary."""
        last, before = np.append(NONE, places[:-1]), np.concatenate([[NONE, NONE], places])[: len(places)]
        last[starts] = before[starts] = NONE
        second = starts[np.append(starts[1:], len(places)) - starts > 1] + 1
        before[second] = NONE
        total = np.zeros(len(places))
        # Contexts of two outcomes are in the table of normalisers.
        near, far = context_outcome(last, self.rest), context_outcome(before, self.rest)
        plain = (near != self.rest) & (far != self.rest)
        i = np.flatnonzero(plain)
        outcome = np.where((places[i] < 0) | (places[i] > self.rest), self.rest, places[i])
        total[i] = self.model.log_prob(near[i], far[i], outcome)
        i = i[outcome == self.rest]
        total[i] += self.leaf(self.context(last[i], before[i]), places[i])
        i = np.flatnonzero(~plain & (last != OUTSIDE) & (before != OUTSIDE))
        context = self.context(last[i], before[i])
        total[i] = self.token(context, places[i], self.known_log_z(last[i], before[i], context))
        return total

    def leaf(self, context: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Gain of the leaf of a place of the rest class."""
        return self.tree.gain(np.where(places >= 0, places - self.rest + 1, 0), context - self.centre)

    def known_log_z(self, last: np.ndarray, before: np.ndarray, context: np.ndarray) -> np.ndarray:
        """``log_z`` of contexts of places: from the table of pairs, else each context once."""
        near, far = (np.where(p == NONE, self.pairs, p) for p in (last, before))
        i = np.flatnonzero((near < self.pairs + (last == NONE)) & (far < self.pairs + (before == NONE)))
        log_z = np.full(len(last), np.nan, np.float32)
        if len(i):
            log_z[i] = self.pair_log_z[near[i], far[i]]
        i = np.flatnonzero(np.isnan(log_z))
        _, first, again = np.unique((last[i] - NONE) << 32 | (before[i] - NONE), return_index=True, return_inverse=True)
        log_z[i] = self.log_z(context[i[first]])[again]
        return log_z

    def log_z(self, context: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all outcomes of exp(vector * context + constant)."""
        out = np.zeros(len(context), np.float32)
        # Most contexts are too short for an exponential to leave its range; the others need their largest logit.
        short = np.sqrt(np.einsum("ij,ij->i", context, context)) * self.most + self.most_bias <= 80
        ones = np.ones(len(self.out), np.float32)
        # Logits of few enough tokens stay in a core's cache.
        guess, logits = np.ones((self.width + 1, 128), np.float32), np.empty((len(self.out), 128), np.float32)
        for rows, far in ((np.flatnonzero(short), False), (np.flatnonzero(~short), True)):
            for at in range(0, len(rows), 128):
                i = rows[at : at + 128]
                guess[:-1, : len(i)] = context[i].T
                np.matmul(self.wide, guess, out=logits)
                top = logits.max(0) if far else np.float32(0)
                if far:
                    np.subtract(logits, top, out=logits)
                out[i] = ((np.log2(ones @ np.exp2(logits, out=logits)) + top) * np.float32(math.log(2)))[: len(i)]
        return out

    def token(self, context: np.ndarray, places: np.ndarray, log_z: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of the outcome, and below the rest class of the leaf over its share."""
        outcome = np.where((places < 0) | (places > self.rest), self.rest, places)
        total = np.einsum("ij,ij->i", context, self.out[outcome]).astype(np.float64) + self.bias[outcome]
        total -= self.log_z(context) if log_z is None else log_z
        low = np.flatnonzero(outcome == self.rest)
        total[low] += self.leaf(context[low], places[low])
        return total


def score_texts(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    outcomes: int = OUTCOMES,
    dictionary: int = DICTIONARY,
    width: int = WIDTH,
    seed: int = 42,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row.

    ``base_score`` is the smoothed unigram and ``score`` the model's log10 probability
    of the text with its end. Counts and model learn from all rows that are not held out.

    * A null or empty text is its end alone; repeated rows and null ids are rows like others.
    * Without training rows every known count is 0 and all tokens are in the rest class.
    * An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    texts = packed(docs).select(
        F.col(f"row.{id}").alias("doc_id"),
        is_held_out(F.col(f"row.{id}")).alias("held_out"),
        whole(F.col(f"row.{text}")).alias("text"),
    )
    counts = materialize(count_tokens(texts.where(~F.col("held_out"))), "token-counts", "zstd")
    words = vocabulary(counts, outcomes, dictionary)
    share = words.shares()
    shape = Shape(words.outcomes, width)
    known = spark.sparkContext.broadcast(words.words)
    rows = materialize(encoded(texts, known).withColumn("at", F.monotonically_increasing_id()), "texts", "zstd")
    learnt = rows.where(~F.col("held_out"))
    flat = train(learnt, shape, share, seed=seed)
    rest, d = words.outcomes - 1, width

    # Words of the rest class: their sums, then their own vectors and their places in the trees.
    one, two, out, bias = (a.astype(np.float64) for a in shape.split(flat))
    follows, leads = Newton([out], share), Newton([one[:-1], two[:-1]], share)
    terms = Sums(shape, flat, leads.mean)

    def coded(places: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the tokens of a text."""
        at = unpack_places(places)
        return at, terms.encode(*contexts(at, shape.outcomes))

    inside = occurrences(learnt, len(words.words) - rest, coded, terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the driver needs of a word's sums: those of the contexts before it, and its own vectors."""
        for batch in batches:
            n = batch.column("n").to_numpy()
            sums = np.frombuffer(b"".join(values_of(batch.column("sums")))).reshape(-1, 3 * d)
            made = np.concatenate([follows(sums[:, d : 2 * d], n), follows(sums[:, 2 * d :], n)], 1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("place"), binary_rows(sums[:, :d]), binary_rows(made)], ["place", "leads", "own"])

    inside = sums_by_place(inside, terms).mapInArrow(vectors, "place int, leads binary, own binary").toArrow()  # `dictionary` rows at most
    before = np.zeros((1 + len(words.words) - rest, d))  # the first row is kept for all words outside the dictionary
    own = np.zeros((len(words.words) - rest, 2 * d), np.float32)
    for batch in inside.to_batches():
        at = batch.column("place").to_numpy() - rest
        before[at + 1] = np.frombuffer(b"".join(values_of(batch.column("leads")))).reshape(-1, d)
        own[at] = np.frombuffer(b"".join(values_of(batch.column("own"))), np.float32).reshape(-1, 2 * d)
    del inside
    n_stems = max(-(-(words.distinct - len(words.words)) // STEM), 1)
    found = stem_rows(rows, n_stems, terms)
    found = materialize(found, "word-occurrences", "zstd")
    stems = found.select("stem", "n", "words", "sums").toArrow()  # one row per STEM words
    trunk_n, trunk_sums = np.zeros(n_stems), np.zeros((n_stems, d))
    trunk_mass, at = np.zeros(n_stems), stems.column("stem").to_numpy()
    if len(at):
        trunk_n[at] = stems.column("n").to_numpy()
        trunk_mass[at] = trunk_n[at] + stems.column("words").to_numpy()
        trunk_sums[at] = np.array(stems.column("sums").to_pylist())
    out_mass = trunk_mass.sum() + 1  # one for unknown words
    n = words.counts[rest:].astype(float)
    before[0] = trunk_sums.sum(0)
    near_tree = Tree(np.append(trunk_n.sum(), n), np.append(out_mass, n + 1), before, leads)
    del before
    trunk = spark.sparkContext.broadcast(Tree(trunk_n, trunk_mass, trunk_sums, leads))
    # The table's work stays a small part of the texts'.
    pairs = min(PAIRS, math.isqrt(words.train_tokens), len(words.words))
    scorer = spark.sparkContext.broadcast(Scorer(shape, flat, near_tree, own, leads.mean, pairs))
    logs = spark.sparkContext.broadcast(np.log10(words.counts + 1.0))
    base_total, rest_total = math.log10(words.train_tokens + words.distinct + 1), math.log10(words.rest_total())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a text's dictionary says: all tokens with no word outside it in their context."""
        log, of = logs.value, scorer.value
        for batch in batches:
            texts = [unpack_places(raw.as_py()) for raw in batch.column("places")]
            sizes = np.array([len(t) for t in texts])
            sums = []
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1):
                places = np.concatenate([texts[i] for i in some])
                starts = np.cumsum(sizes[some]) - sizes[some]
                known, low = places >= 0, (places < 0) | (places >= rest)
                base = np.where(known, log[places.clip(0)], 0.0) if len(log) else np.zeros(len(places))
                more = of.tokens(places, starts) / math.log(10) + np.where(low, base - rest_total, 0.0)
                sums.append([np.add.reduceat(x, starts) for x in (known.astype(np.int64), base - base_total, more)])
            known, base, more = (np.concatenate(x) for x in zip(*sums))
            columns = [*(batch.column(c) for c in ("doc_id", "held_out", "at")), *(pa.array(x) for x in (sizes, known, base, more))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "at", "n_tokens", "n_known", "base", "score"])

    def own_vectors(c: dict[str, np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences and sums of a stem's training words, and own vectors of all its rows."""
        times, sums = terms.of_rows(c, n_words)
        made = np.concatenate([follows(sums[:, d : 2 * d], times), follows(sums[:, 2 * d :], times)], 1)
        made = np.concatenate([made, np.zeros((1, 2 * d))]).astype(np.float16).astype(np.float32)
        return times, sums[:, :d], made[c["leaf"]]  # the last row: words never seen

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What words outside the dictionary add, where no other one stands in their token or its context."""
        of = scorer.value
        for batch in batches:
            for r in batch.to_pylist():
                c = unpack_columns(r["packed"])
                times, sums, mine = own_vectors(c, r["words"])
                zero = np.zeros((len(mine), d), np.float32)
                more = zero[:, 0].astype(np.float64)
                known = c["leaf"] >= 0
                near, far, next_, third = c["m1"], c["m2"], c["p1"], c["p2"]
                i = np.flatnonzero(known & (near != OUTSIDE) & (far != OUTSIDE))
                leaves = Tree(times, times + 1.0, sums.astype(np.float64), leads)
                h = of.context(near[i], far[i]) - of.centre
                more[i] += leaves.gain(c["leaf"][i], h) + trunk.value.gain(np.full(len(i), r["stem"]), h)
                i = np.flatnonzero((next_ >= 0) & (near != OUTSIDE))
                more[i] += of.token(of.context(np.full(len(i), OUTSIDE), near[i]) + mine[i, :d], next_[i])
                i = np.flatnonzero((next_ >= 0) & (third >= 0))
                more[i] += of.token(of.context(next_[i], np.full(len(i), OUTSIDE)) + mine[i, d:], third[i])
                base = np.where(known, np.log10(np.append(times, 0) + 1.0)[c["leaf"]], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (c["at"], known.astype(np.int64), base, base + more / math.log(10))],
                    ["at", "more_known", "more_base", "more_score"],
                )

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words outside the dictionary with another one near: what their common tokens need."""
        for batch in batches:
            for r in batch.to_pylist():
                c = unpack_columns(r["packed"])
                i = np.flatnonzero((c["m1"] == OUTSIDE) | (c["m2"] == OUTSIDE) | (c["p1"] == OUTSIDE) | (c["p2"] == OUTSIDE))
                mine = own_vectors(c, r["words"])[2][i].astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c[x][i]) for x in ("at", "pos")),
                        pa.array(np.full(len(i), r["stem"], np.int32)),
                        *(pa.array(c[x][i].astype(np.int32)) for x in ("leaf", "m1", "m2", "p1")),
                        binary_rows(mine),
                    ],
                    ["at", "pos", "stem", "leaf", "m1", "m2", "p1", "own"],
                )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """Columns in order of text and place, own vectors, and contexts; the last two rows go on to the next batch."""
        of, kept = scorer.value, None
        for batch in batches:
            c = {x: batch.column(x).to_numpy() for x in ("at", "pos", "stem", "leaf", "m1", "m2", "p1")}
            mine = np.frombuffer(b"".join(values_of(batch.column("own"))), np.float16).reshape(-1, 2 * d).astype(np.float32)
            skip = 0
            if kept is not None:
                skip = len(kept[1])
                c, mine = {x: np.concatenate([kept[0][x], c[x]]) for x in c}, np.concatenate([kept[1], mine])
            kept = {x: v[-2:] for x, v in c.items()}, mine[-2:]
            extra = np.zeros((len(mine), d), np.float32)
            for back in (1, 2):  # rows before, in which the words one and two places before may stand
                same = np.flatnonzero(c["at"][back:] == c["at"][:-back]) + back
                gap = c["pos"][same] - c["pos"][same - back]
                for places, half in ((1, slice(0, d)), (2, slice(d, 2 * d))):
                    i = same[gap == places]
                    extra[i] += mine[i - back][:, half]
            # The word one place before, as the one two places before the next token.
            one_before = np.zeros((len(mine), d), np.float32)
            i = np.flatnonzero((c["at"][1:] == c["at"][:-1]) & (c["pos"][1:] == c["pos"][:-1] + 1)) + 1
            one_before[i] = mine[i - 1, d:]
            h = of.context(c["m1"], c["m2"]) + extra
            after = of.context(np.full(len(mine), OUTSIDE), c["m1"]) + mine[:, :d] + one_before
            yield {x: v[skip:] for x, v in c.items()}, h[skip:], after[skip:]

    def score_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer.value
        for c, h, after in neighbours(batches):
            more = np.zeros(len(h))
            i = np.flatnonzero((c["m1"] == OUTSIDE) | (c["m2"] == OUTSIDE))
            more[i] += of.token(h[i], np.full(len(i), OUTSIDE))
            i = np.flatnonzero((c["m1"] == OUTSIDE) & (c["p1"] >= 0))
            more[i] += of.token(after[i], c["p1"][i])
            zero = np.zeros(len(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (c["at"], zero.astype(np.int64), zero, more / math.log(10))],
                ["at", "more_known", "more_base", "more_score"],
            )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts in which leaves are asked for that could not be known beside the leaf."""
        for c, h, _ in neighbours(batches):
            i = np.flatnonzero((c["leaf"] >= 0) & ((c["m1"] == OUTSIDE) | (c["m2"] == OUTSIDE)))
            context = (h[i] - scorer.value.centre).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[x][i]) for x in ("stem", "leaf", "at")), binary_rows(context)],
                ["stem", "leaf", "at", "context"],
            )

    def choose(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(mine):
            return pd.DataFrame({"at": [], "more_known": [], "more_base": [], "more_score": []})
        stem = int(mine["stem"].iloc[0])
        times, sums = terms.of_rows(unpack_columns(mine["packed"].iloc[0]), int(mine["words"].iloc[0]))
        leaves = Tree(times, times + 1.0, sums[:, :d].astype(np.float64), leads)
        context = np.frombuffer(b"".join(asked["context"]), np.float16).reshape(-1, d).astype(np.float32)
        gain = leaves.gain(asked["leaf"].to_numpy(), context) + trunk.value.gain(np.full(len(asked), stem), context)
        return pd.DataFrame({"at": asked["at"], "more_known": 0, "more_base": 0.0, "more_score": gain / math.log(10)})

    part = rows.select("doc_id", "held_out", "at", "places").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, at long, n_tokens long, n_known long, base double, score double"
    )
    more = "at long, more_known long, more_base double, more_score double"
    of_stems = found.select("stem", "words", "packed")
    near = (
        of_stems.mapInArrow(clustered, "at long, pos long, stem int, leaf int, m1 int, m2 int, p1 int, own binary")
        .repartition("at")
        .sortWithinPartitions("at", "pos")
    )
    contexts_ = near.mapInArrow(asked, "stem int, leaf int, at long, context binary")
    chosen = of_stems.groupBy("stem").cogroup(contexts_.groupBy("stem")).applyInPandas(choose, more)
    added = (
        of_stems.mapInArrow(score_words, more)
        .unionByName(near.mapInArrow(score_clusters, more))
        .unionByName(chosen)
        .groupBy("at")
        .agg(*[F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score")])
    )
    return part.join(added, "at", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
