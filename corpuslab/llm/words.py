"""Words of a batch of texts as arrays.

Words are the runs of bytes other than space and 0x09-0x0D. These separators are ASCII, so
cutting the UTF-8 bytes gives the same words as cutting the characters. Everything is
computed for a whole Arrow batch at once: positions, documents and 64-bit hashes of the
words after lower-casing A-Z. The hash of a word is a polynomial over a table of mixed byte
values, mixed again with its length; it depends on nothing but the bytes, so all tasks and
reruns agree. Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
IS_WS = np.zeros(256, bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets."""
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """``start``, ``length`` of each word in ``data``; ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = bytes_of(texts)
        n = self.data.size
        inside = np.zeros(n + 2, bool)  # one guard at either end
        inside[1:-1] = ~IS_WS[self.data]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = self.off[(self.off > 0) & (self.off < n)]
        opens[edge] |= inside[1:-1][edge]  # a text begins: so does a word
        closes[edge - 1] |= inside[1:-1][edge - 1]
        self.start = np.flatnonzero(opens)
        self.length = np.flatnonzero(closes) + 1 - self.start
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return self.start.size

    def doc(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(self.count.size), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.empty(0, np.uint64)
        n = self.data.size
        place = np.arange(n, dtype=np.int64)
        gap = np.diff(np.append(self.start, n))
        place[self.start[0]:] -= np.repeat(self.start, gap)
        longest = int(gap.max()) + 1
        power = np.cumprod(np.concatenate([[U(1)], np.full(longest, BASE)]), dtype=np.uint64)
        value = BYTE[LOWER[self.data]]
        value[IS_WS[self.data]] = 0
        value[:self.start[0]] = 0
        value *= power[np.minimum(place, longest)]
        return mix(np.add.reduceat(value, self.start) + self.length.astype(np.uint64) * BASE)

    def text(self, i: int) -> bytes:
        """The bytes of word i."""
        return self.data[self.start[i]:self.start[i] + self.length[i]].tobytes()


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows within each text, and the text of each window."""
    count = np.diff(first)
    if hashes.size < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined = hashes[:hashes.size - n + 1].copy()
    for k in range(1, n):
        joined = joined * BASE + hashes[k:hashes.size - n + 1 + k]
    doc = np.repeat(np.arange(count.size), count)
    whole = doc[:joined.size] == doc[n - 1:]
    return mix(joined[whole]), doc[:joined.size][whole]
