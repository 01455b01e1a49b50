"""64-bit hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

# Bytes hashed at a time; a longer text is taken in parts that end between words.
CHUNK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def _chunk_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of ``raw``; a hash depends on the word's bytes alone."""
    codes = np.frombuffer(raw, np.uint8)
    word = ~_IS_SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            yield _long_words(texts[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size += len(texts[j]) + 1
            j += 1
        starts, hashes = _chunk_words(b" ".join(texts[i:j]))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts, cuts[1:]):
            yield hashes[a:b]
        i = j


def _long_words(raw: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(raw):
        end = at + CHUNK
        if end < len(raw):  # go back to white space; a word longer than a chunk is taken whole
            inside = np.flatnonzero(_IS_SPACE[np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                after = np.flatnonzero(_IS_SPACE[np.frombuffer(raw, np.uint8, -1, end)])
                end = end + int(after[0]) if len(after) else len(raw)
        parts.append(_chunk_words(raw[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    wide = min(width, len(words))
    total = np.full(len(words) - wide + 1, wide, np.uint64)
    for k in range(wide):
        total = mix(total * _BASE + words[k : len(words) - wide + 1 + k])
    return np.unique(total)
