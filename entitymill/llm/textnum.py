"""Numpy arithmetic on the words of many texts at once.

A batch of texts is one UTF-8 buffer. A word is a run of bytes outside
0x20 and 0x09-0x0D, which is the same as ``[^\\x20\\x09-\\x0D]+`` on code points.
Words get 64-bit polynomial hashes from prefix sums, so no loop runs over
texts or words. Hashes only bring equal words together; 64 bits make a chance
collision within one text or one pair of texts negligible (about n^2 / 2^65).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C17
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling (xor-shift and multiply), in place on a copy."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length() if n < 1 << 22 else n
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte buffer, and the offsets of each text; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[buf] if lower else buf), off - off[0]


class Words:
    """The words of a batch: byte starts and ends, text index, hashes. ``space`` tells the bytes between words."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        self.buf, self.off = utf8(column, lower)
        self.n = len(column)
        word = ~space[self.buf]
        full = self.off[:-1] < self.off[1:]
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        before[self.off[:-1][full]] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        after[self.off[1:][full] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        bounds = np.searchsorted(self.start, self.off)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def hashes(self) -> np.ndarray:
        powers, inverse = _power_tables(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, U)
        np.cumsum(_BYTE[self.buf] * powers[: len(self.buf)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (text index, hash), sorted; a shorter text is one shingle."""
    h = words.hashes()
    n = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    doc = np.repeat(np.arange(words.n), n)
    at = words.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(words.count, k)[doc]
    out = mix(length.astype(U) + U(0x51ED27))
    for j in range(k):
        live = length > j
        step = mix(out * U(0x9E3779B97F4A7C15) + h[np.minimum(at + j, max(len(h) - 1, 0))]) if len(h) else out
        out = np.where(live, step, out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[fresh], out[fresh]


def sums_by(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Wrap-around sums of sorted groups; 0 for a group without rows."""
    total = np.zeros(len(value) + 1, value.dtype)
    np.cumsum(value, out=total[1:])
    bounds = np.searchsorted(doc, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]
