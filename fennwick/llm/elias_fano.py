"""Elias-Fano coding of non-decreasing integers, with a sampled select structure.

A value's low bits are stored as they are, its high part as the gap to the bit of the value before in a bit vector, so
n values below u take about 2 + log2(u / n) bits each. The position of every ``SAMPLE``-th set bit is kept; ``select``
reads one value from there without decoding the others.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = "<QQBQ"


def encode(values: np.ndarray) -> bytes:
    v = np.asarray(values, dtype=np.uint64)
    n, top = len(v), int(v[-1]) + 1 if len(v) else 1
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = v & np.uint64((1 << low_bits) - 1)
    bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    size = (int(at[-1]) if n else 0) + 1
    high = np.zeros(size, np.uint8)
    high[at] = 1
    packed_low, packed_high = np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    samples = at[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(_HEAD, n, top, low_bits, len(packed_high)) + samples + packed_low + packed_high


class EliasFano:
    """A view on an encoded sequence that begins at ``offset`` of ``buffer``; ``end`` is where it stops."""

    def __init__(self, buffer: bytes, offset: int = 0):
        self.n, self.top, self.low_bits, n_high = struct.unpack_from(_HEAD, buffer, offset)
        at = offset + struct.calcsize(_HEAD)
        n_samples, n_low = -(-self.n // SAMPLE), -(-self.n * self.low_bits // 8)
        self.samples = np.frombuffer(buffer, "<u4", n_samples, at)
        self.low = np.frombuffer(buffer, np.uint8, n_low, at + 4 * n_samples)
        self.high = np.frombuffer(buffer, np.uint8, n_high, at + 4 * n_samples + n_low)
        self.end = at + 4 * n_samples + n_low + n_high

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        word = int(self.high[byte]) >> skip << skip
        while (ones := word.bit_count()) <= rest:
            rest -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(rest):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return (position - i) << self.low_bits | int(self._low(i, i + 1)[0])
