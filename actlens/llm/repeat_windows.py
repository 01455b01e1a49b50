"""Byte windows of a text and the anchors they hang on, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from actlens.llm.word_hash import mix

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BACKS = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

# Window starts handled at a time; the place inside such a part fits in PLACE bits.
PART = 1 << 22
PLACE = 24


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables.get(which, (np.zeros(0, np.uint64),) * 2)
    if len(up) < n:
        n = max(n, 1 << 17)
        tables = []
        for base in (_BASES[which], _BACKS[which]):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        _tables[which] = up, down = tables[0], tables[1]
    return up[:n], down[:n]


class Hashes:
    """Hashes of any byte range of ``codes`` from one prefix sum (equal ranges, equal hashes)."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        up, self.down = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        """Of every range of ``length``."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the first of equal ones (by the high bits)."""
    n = len(values)
    low = np.uint64((1 << PLACE) - 1)
    coded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    coded[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = coded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & low).astype(np.int64)


def anchors(raw: bytes, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, span hash, first, last, place) of each anchor, in parts of the text.

    A window's anchor is its gram with the smallest hash, so equal windows have equal
    anchors at equal places. The starts ``first`` … ``last`` of the windows of an anchor
    are neighbours; the span is all bytes of these windows, and its hash also tells
    where the anchor lies in it.
    """
    for at in range(0, max(len(raw) - window + 1, 0), PART):
        codes = np.frombuffer(raw, np.uint8, min(PART + window - 1, len(raw) - at), at)
        hashes = Hashes(codes)
        grams = hashes.all(gram)
        place = sliding_argmin(grams, window - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        here = place[first]
        span = mix(hashes.of(first, last + window) ^ mix((here - first).astype(np.uint64)))
        yield grams[here].view(np.int64), span.view(np.int64), first + at, last + at, here + at


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, sorted, those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
