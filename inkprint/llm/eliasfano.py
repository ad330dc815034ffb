"""Elias-Fano coded monotone sequences, searched by arrays of values."""

from __future__ import annotations

import numpy as np

ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Place of the k-th zero of a byte, 8 where it has fewer.
ZERO = np.array(
    [[([p for p in range(8) if not b >> p & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], dtype=np.uint8
)


class EliasFano:
    """A rising sequence of distinct 64-bit values.

    The upper bits of a value are written in unary: they are monotone pointers from each run of
    equal upper bits to its lower bits, which stand in the smallest integer type that holds them. A
    search goes to the run of the value's upper bits and halves it. All parts are flat arrays, so
    that a sequence can lie in a mapped file.
    """

    def __init__(self, size: int, shift: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.size, self.shift, self.low, self.high, self.zeros = size, shift, low, high, zeros

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, (top // max(n, 1)).bit_length() - 1)
        kind = np.uint8 if shift <= 8 else np.uint16 if shift <= 16 else np.uint32 if shift <= 32 else np.uint64
        low = (values & np.uint64((1 << shift) - 1)).astype(kind)
        upper = (values >> np.uint64(shift)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> shift) + 2) // 64) * 64, dtype=np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        per_word = 64 - ONES[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return EliasFano(n, shift, low, high, np.concatenate([[0], np.cumsum(per_word)]))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, byte = k - self.zeros[word], word * 8
        for _ in range(7):
            here = 8 - ONES[self.high[byte]].astype(np.int64)
            step = left >= here
            left = left - np.where(step, here, 0)
            byte = byte + step
        return byte * 8 + ZERO[self.high[byte], left]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Number of each value in the sequence, -1 where it is not there."""
        values = np.asarray(values, dtype=np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        upper = values >> np.uint64(self.shift)
        inside = np.flatnonzero(upper <= np.uint64(max(0, int(self.zeros[-1]) - 2))) if self.size else []
        if not len(inside):
            return out
        h = upper[inside].astype(np.int64)
        first = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        last = self._zero(h) - h
        want = (values[inside] & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype)
        a, b = first.copy(), last.copy()
        active = np.flatnonzero(a < b)
        while len(active):
            middle = (a[active] + b[active]) >> 1
            less = self.low[middle] < want[active]
            a[active[less]] = middle[less] + 1
            b[active[~less]] = middle[~less]
            active = active[a[active] < b[active]]
        found = a < last
        found[found] = self.low[a[found]] == want[found]
        out[inside[found]] = a[found]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.size, self.shift], dtype=np.int64), self.low, self.high, self.zeros]

    @staticmethod
    def from_parts(parts: list[np.ndarray]) -> EliasFano:
        return EliasFano(int(parts[0][0]), int(parts[0][1]), *parts[1:])
