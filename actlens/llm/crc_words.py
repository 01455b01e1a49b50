"""CRC-32 of word runs composed from the words' payloads, which an Aho-Corasick automaton emits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np

_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
_SPACE = zlib.crc32(b" ")

# Words an automaton holds at most, per Python worker; other words are summed directly.
DICTIONARY = 1 << 16
# Bytes scanned at a time; a longer text is taken in parts that end between words.
CHUNK = 1 << 22

# Delimiters (ASCII but letters and digits) become spaces, A-Z lower case, other bytes stay.
_FOLDED = bytes(
    b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256)
)


def _zero_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given by its values on each of the four bytes."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps of 0 to 63 zero bytes, and of 64, 128, 256 … zero bytes."""
    zero = _zero_byte()
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    low = []
    for _ in range(64):
        low.append(table)
        table = zero[table & 255] ^ (table >> 8)
    high = [table]
    while len(high) < 26:
        high.append(_apply(high[-1], high[-1]))
    return np.stack(low), high


_LOW, _HIGH = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs' part in the CRC of a string that goes on for ``length`` bytes.

    crc32(a + b) is ``shifted(crc32(a), len(b)) ^ crc32(b)``.
    """
    at = length & 63
    out = (
        _LOW[at, 0, crc & 255] ^ _LOW[at, 1, (crc >> 8) & 255]
        ^ _LOW[at, 2, (crc >> 16) & 255] ^ _LOW[at, 3, crc >> 24]
    )
    for j in range((int(length.max(initial=0)) >> 6).bit_length()):
        rows = np.flatnonzero((length >> (6 + j)) & 1)
        out[rows] = _apply(_HIGH[j], out[rows])
    return out


class Payloads:
    """CRC and length of every word of a text, the frequent ones from an automaton.

    The dictionary is the worker's own: a word met twice outside it is put in, until it
    is full, so nothing of the corpus is gathered anywhere. It saves work only; a word
    outside it gives the same payload from its bytes.
    """

    def __init__(self, size: int = DICTIONARY):
        self.size = size
        self.words: dict[bytes, int] = {}
        self.crc, self.spaced = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.once: set[bytes] = set()
        self.new: dict[bytes, None] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def _learn(self) -> None:
        """Build the automaton anew once the new words are a quarter of it, or fill it."""
        room = self.size - len(self.words)
        if not room or len(self.new) < min(room, max(1024, len(self.words) // 4)):
            return
        for word in list(self.new)[:room]:
            self.words[word] = len(self.words)
        self.new, self.once = {}, set()
        sums = [zlib.crc32(w) for w in self.words], [zlib.crc32(w, _SPACE) for w in self.words]
        self.crc, self.spaced = (np.array(x, np.uint32) for x in sums)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, number in self.words.items():
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        self.automaton.make_automaton()

    def scan(self, folded: bytes) -> tuple[np.ndarray, ...]:
        """(start, length, CRC, CRC of a space and the word) of each word.

        ``folded`` has words between spaces, and a space at both ends. A pattern is
        a word with its delimiters, so each word is hit by itself alone.
        """
        letter = np.frombuffer(folded, np.uint8) != 0x20
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        crc, spaced = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
        known = np.zeros(len(starts), bool)
        if self.automaton is not None:
            hits = self.automaton.iter(folded.decode("latin-1"))
            at = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
            place = np.searchsorted(ends, at[:, 0])
            crc[place], spaced[place], known[place] = self.crc[at[:, 1]], self.spaced[at[:, 1]], True
        full = len(self.words) >= self.size
        rest = np.flatnonzero(~known)
        for i, a, b in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist()):
            word = folded[a:b]
            crc[i], spaced[i] = zlib.crc32(word), zlib.crc32(word, _SPACE)
            if full:
                continue
            if word in self.once:
                self.new[word] = None
            elif len(self.once) < self.size:
                self.once.add(word)
        if not full:
            self._learn()
        return starts, ends - starts, crc, spaced


def _parts(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Folded texts with spaces around them, in parts that end between words.

    With each part, the texts in it and the places where they begin.
    """
    joined, who, at, size = [], [], [], 1
    for i, text in enumerate(texts):
        folded = text.translate(_FOLDED)
        begin = 0
        while begin < len(folded):
            end = len(folded)
            if end - begin > CHUNK:
                end = folded.rfind(b" ", begin, begin + CHUNK) + 1 or folded.find(b" ", begin + CHUNK) + 1 or end
            joined.append(folded[begin:end])
            who.append(i)
            at.append(size)
            size += end - begin + 1
            begin = end
            if size > CHUNK:
                yield b" ".join([b"", *joined, b""]), who, at
                joined, who, at, size = [], [], [], 1
    if joined:
        yield b" ".join([b"", *joined, b""]), who, at


def run_buckets(
    texts: list[bytes], payloads: Payloads, buckets: int, longest: int = 3
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for runs of 1 to ``longest`` words the arrays (text, bucket).

    A run's CRC is composed from the run one word shorter and the payload of the next word.
    """
    owners, lengths, sums, spaced_sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
    for part, who, at in _parts(texts):
        starts, length, crc, spaced = payloads.scan(part)
        owners.append(np.array(who)[np.searchsorted(at, starts, "right") - 1])
        lengths.append(length)
        sums.append(crc)
        spaced_sums.append(spaced)
    owner, length = np.concatenate(owners), np.concatenate(lengths)
    empty = np.zeros(0, np.uint32)
    run = np.concatenate([empty, *sums])
    spaced = np.concatenate([empty, *spaced_sums])
    runs = []
    for k in range(longest):
        if k:
            run = shifted(run[:-1], length[k:] + 1) ^ spaced[k:]
        first, last = owner[: len(run)], owner[k:]
        whole = first == last
        runs.append((first[whole], (run[whole] % np.uint32(buckets)).astype(np.int64)))
    return np.bincount(owner, minlength=len(texts)), runs
