"""Vectorised words of an Arrow column of texts: boundaries and 64-bit hashes without a Python loop over words.

All texts of a batch are one byte array.  A word is a run of bytes other than 0x20 and 0x09-0x0D inside one text;
bytes A-Z are lower-cased.  A word's hash is a polynomial over a fixed random byte table, read off a prefix sum and
finalised with splitmix64, so its cost is a few array operations a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed * 1000)) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTE = constants(256, 1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept and grown as needed."""
    have = _powers.get(int(base), np.ones(1, np.uint64))
    while len(have) < n:
        step = have[-1:] * base
        have = np.concatenate([have, have * step])
    _powers[int(base)] = have
    return have[:n]


class Words:
    """Words of a chunk of texts.  Word i of text d has index first[d] + i; first has one entry more than texts."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        flat = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = flat.buffers()
        at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        self.space = space = _SPACE[raw]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            inner = self.at[(self.at > 0) & (self.at < n)]
            before[inner] = True
            after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the byte ranges; of the words by default."""
        start, end = (self.start if start is None else start), (self.end if end is None else end)
        if not len(start):
            return np.zeros(0, np.uint64)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, len(self.data)), out=self._sums[1:])
        value = (self._sums[end] - self._sums[start]) * _power(_INVERSE, len(self.data) + 1)[start]
        return mix(value + (end - start).astype(np.uint64) * _BASE)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, text by text, and the first index of each text.

    A text of one to n-1 words gives one shingle, its whole sequence; one without words gives none.
    """
    h, first = words.hashes(), words.first
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    index = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], made)
    length = np.repeat(np.minimum(count, n), made)
    odd = constants(n, 2)
    value = length.astype(np.uint64) * _BASE
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for j in range(n):
        value = value + np.where(j < length, padded[index + j], U(0)) * odd[j]
    return mix(value), begin


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    row = 0
    while row < len(sizes):
        done = total[row - 1] if row else 0
        last = max(row + 1, int(np.searchsorted(total, done + CHUNK_BYTES, "right")))
        yield row, last
        row = last


class Index:
    """Exact positions of 64-bit keys by open addressing, looked up for whole arrays; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = U(size - 1)
        self.slot = np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self.keys & self.mask
        while len(left):
            free = self.slot[at[left]] < 0
            self.slot[at[left][free]] = left[free]
            left = left[self.slot[at[left]] != left]
            at[left] = (at[left] + U(1)) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        found = self.slot[at]
        if not len(self.keys):
            return found
        left = np.flatnonzero((found >= 0) & (self.keys[found] != h))
        while len(left):
            at[left] = (at[left] + U(1)) & self.mask
            got = self.slot[at[left]]
            found[left] = got
            left = left[(got >= 0) & (self.keys[got] != h[left])]
        return found
