"""Words below the neural outcomes: vectors of their own, and a normalised tree of log-bilinear choices.

The neural model knows a fixed number of outcomes and one rest class. Every training word
of that class gets, from sums over its occurrences, two context vectors (added to those of
the class) and a place in a tree of fan-out 16. A child is chosen with a probability
proportional to its smoothed count times exp(its vector * context). All are one Newton
step from zero under a Gaussian prior, so a word's sums are all that has to be moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
PRIOR = 4.0
FLUSH = 500_000
# Tokens that go down a tree together.
TOGETHER = 16384
# A word seen so often in one flush is moved as sums, others as their occurrences.
MANY = 16
# Places of a bucket, as a power of two.
BITS = 9
# Instead of a place in the dictionary: a word that has none, and no token at all.
OUTSIDE, NONE = -1, -2


def context_outcome(places: np.ndarray, rest: int) -> np.ndarray:
    """Outcomes of places as contexts; the place before a text follows the rest class."""
    return np.where(places == NONE, rest + 1, np.where((places < 0) | (places > rest), rest, places)).astype(np.int64)


class Newton:
    """Solves (n * covariance + prior) x = gradient for many rows."""

    def __init__(self, vectors: list[np.ndarray], share: np.ndarray, prior: float = PRIOR):
        self.mean = sum(share @ v for v in vectors)
        spread = sum((v - share @ v).T @ ((v - share @ v) * share[:, None]) for v in vectors)
        self.scale, self.axes = np.linalg.eigh(spread)
        self.scale, self.prior = self.scale.clip(0), prior

    def __call__(self, gradient: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (gradient @ self.axes / (n[:, None] * self.scale + self.prior)) @ self.axes.T


class Tree:
    """Leaves in order; ``levels`` hold per node the vectors of its children and their log shares."""

    def __init__(self, n: np.ndarray, mass: np.ndarray, sums: np.ndarray, newton: Newton):
        """``n`` occurrences, smoothed counts and summed (centred) contexts of the leaves."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(mass) > 1 or not self.levels:
            more = -len(mass) % FAN
            if more:
                n, mass, sums = np.pad(n, (0, more)), np.pad(mass, (0, more)), np.pad(sums, ((0, more), (0, 0)))
            here, whole, total = (x.reshape(-1, FAN, *x.shape[1:]) for x in (n, mass, sums))
            share = whole / np.maximum(whole.sum(1, keepdims=True), 1e-300)
            vectors = np.empty(total.shape, np.float32)
            for at in range(0, len(here), 256):  # in parts, as the driver has little room beside the tree
                some = total[at : at + 256]
                pull = some - share[at : at + 256, :, None] * some.sum(1, keepdims=True)
                vectors[at : at + 256] = newton(pull.reshape(-1, pull.shape[2]), here[at : at + 256].ravel()).reshape(pull.shape)
            with np.errstate(divide="ignore"):
                self.levels.insert(0, (vectors, np.log(share).astype(np.float32)))
            n, mass, sums = here.sum(1), whole.sum(1), total.sum(1)

    def gain(self, leaf: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log of P(leaf | context) over the leaf's share of the counts."""
        out = np.zeros(len(leaf))
        order = np.argsort(leaf, kind="stable")  # one node's tokens stand together
        for at in range(0, len(leaf), TOGETHER):
            i = order[at : at + TOGETHER]
            some, rows = leaf[i], np.arange(len(i))
            h = np.ascontiguousarray(context[i].T)
            total, sums = np.zeros(len(i)), np.ones(len(i))
            for depth, (vectors, shares) in enumerate(self.levels):
                child = some // FAN ** (len(self.levels) - 1 - depth)
                node, child = child // FAN, child % FAN
                first = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
                if len(first) * 32 < len(i):  # many tokens a node
                    pull = np.empty((FAN, len(i)), np.float32)
                    for k, a, b in zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
                        np.add(vectors[k] @ h[:, a:b], shares[k][:, None], out=pull[:, a:b])
                else:
                    pull = np.matmul(vectors[node], h.T[:, :, None])[:, :, 0].T + shares[node].T
                top = pull.max(0)
                pull -= top
                total += pull[child, rows] - shares[node, child]
                sums *= np.exp(pull, out=pull).sum(0)  # from 1 to FAN each
            out[i] = total - np.log(sums)
        return out


class Sums:
    """Terms of the sums of a word, from occurrences written as four outcomes in 64 bits.

    The terms are the centred context before a word, and the outcome vectors one and two
    places after it less their expectation.
    """

    def __init__(self, shape, flat: np.ndarray, centre: np.ndarray):
        self.one, self.two, self.out, bias = (a.astype(np.float32) for a in shape.split(flat))
        self.width, self.rest, self.none = shape.width, shape.outcomes - 1, shape.outcomes + 1
        if self.none >= 1 << 15:
            raise ValueError("an outcome has to fit into 15 bits")
        self.centre = centre.astype(np.float32)

        def expected(contexts: np.ndarray) -> np.ndarray:
            logits = contexts @ self.out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            return (p / p.sum(1, keepdims=True)) @ self.out

        # By the other context.
        self.after = expected(self.one[self.rest] + self.two)
        self.over = expected(self.one + self.two[self.rest])

    def encode(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        padded = np.concatenate([outcome, [self.none, self.none]])
        return last | before << 16 | padded[1:-1] << 32 | padded[2:] << 48

    def decode(self, codes: np.ndarray) -> np.ndarray:
        last, before, next_, third = (codes >> shift & 0xFFFF for shift in (0, 16, 32, 48))
        d = self.width
        terms = np.zeros((len(codes), 3 * d), np.float32)
        terms[:, :d] = self.one[last] + self.two[before] - self.centre
        i = np.flatnonzero(next_ != self.none)
        terms[i, d : 2 * d] = self.out[next_[i]] - self.after[last[i]]
        i = np.flatnonzero(third != self.none)
        terms[i, 2 * d :] = self.out[third[i]] - self.over[next_[i]]
        return terms

    def of_rows(self, columns: dict[str, np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, sums) of words numbered by ``leaf`` in ascending order, from rows of training texts."""
        i = np.flatnonzero(columns["learnt"] == 1)
        if not len(i):
            return np.zeros(n_words, int), np.zeros((n_words, 3 * self.width), np.float32)
        last, before = (context_outcome(columns[c][i], self.rest) for c in ("m1", "m2"))
        # The token after the end is not the one before the start.
        next_, third = (np.where(columns[c][i] == NONE, self.none, context_outcome(columns[c][i], self.rest)) for c in ("p1", "p2"))
        terms = self.decode(last | before << 16 | next_ << 32 | third << 48)
        _, first, times = np.unique(columns["leaf"][i], return_index=True, return_counts=True)
        return times, np.add.reduceat(terms, first, axis=0)


def occurrences(rows: DataFrame, size: int, coded, terms: Sums) -> DataFrame:
    """Occurrences of the dictionary's words of the rest class, a row per ``bucket`` of places and flush.

    ``coded`` gives places and codes of a text's ``places``. A row holds ``places`` (inside the bucket) with
    ``codes``, or for words met often ``n`` and ``sums``.
    """
    rest = terms.rest

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, fixed = np.zeros(max(size, 0), np.int64), None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def records(places: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            """A row per bucket of ascending places."""
            buckets, first = np.unique(places >> BITS, return_index=True)
            ends = np.append(first[1:], len(places))
            columns["places"] = (places & (1 << BITS) - 1).astype("<u2")
            for at in range(0, len(buckets), 64):
                cuts = list(zip(first[at : at + 64], ends[at : at + 64]))
                values = [
                    pa.array([columns[c][a:b].tobytes() for a, b in cuts], pa.binary()) if c in columns else pa.nulls(len(cuts), pa.binary())
                    for c in ("places", "codes", "n", "sums")
                ]
                yield pa.RecordBatch.from_arrays([pa.array(buckets[at : at + 64], pa.int32()), *values], ["bucket", "places", "codes", "n", "sums"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal fixed, held, n_held
            if not held:
                return
            places, codes = (np.concatenate(c) for c in zip(*held))
            held, n_held = [], 0
            order = np.argsort(places, kind="stable")
            places, codes = places[order], codes[order]
            many = np.bincount(places, minlength=size)[places] >= MANY
            if many.any():
                fixed = np.zeros((size, 3 * terms.width), np.float32) if fixed is None else fixed
                ids, first, n = np.unique(places[many], return_index=True, return_counts=True)
                times[ids] += n
                fixed[ids] += np.add.reduceat(terms.decode(codes[many]), first, axis=0)
            yield from records(places[~many], codes=codes[~many])

        for batch in batches:
            for raw in batch.column("places"):
                places, codes = coded(raw.as_py())
                near = places >= rest
                held.append((places[near] - rest, codes[near]))
                n_held += int(near.sum())
                if n_held > FLUSH:
                    yield from flush()
        yield from flush()
        used = np.flatnonzero(times)
        if len(used):
            yield from records(used, n=times[used], sums=fixed[used])

    return rows.select("places").mapInArrow(collect, "bucket int, places binary, codes binary, n binary, sums binary")


def sums_by_place(found: DataFrame, terms: Sums) -> DataFrame:
    """``place``, ``n`` and ``sums`` (doubles) of the dictionary's words."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        n, total = np.zeros(1 << BITS), np.zeros((1 << BITS, 3 * terms.width))
        for places, codes, times, sums in zip(rows["places"], rows["codes"], rows["n"], rows["sums"]):
            at = np.frombuffer(places, "<u2").astype(int)
            if codes is None:
                n[at] += np.frombuffer(times, np.int64)
                total[at] += np.frombuffer(sums, np.float32).reshape(-1, 3 * terms.width)
            else:
                ids, first, each = np.unique(at, return_index=True, return_counts=True)
                n[ids] += each
                total[ids] += np.add.reduceat(terms.decode(np.frombuffer(codes, np.int64)), first, axis=0, dtype=np.float64)
        used = np.flatnonzero(n)
        start = terms.rest + (int(rows["bucket"].iloc[0]) << BITS)
        return pd.DataFrame({"place": used + start, "n": n[used], "sums": [v.tobytes() for v in total[used]]})

    return found.groupBy("bucket").applyInPandas(add, "place int, n double, sums binary")
