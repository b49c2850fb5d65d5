"""A wavelet matrix over numbers below 2^bits: succinct bit-planes with rank and select.

Plane k holds bit k of every number, highest plane first; after each plane the numbers whose bit
is 0 move before those whose bit is 1, both in order. A directory of ones before every block of
512 bits answers rank by one lookup and one partial count, and select by a binary search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK_BITS = 512
_BLOCK_BYTES = BLOCK_BITS // 8
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Positions worked out at a time.
_LOT = 1 << 15


@dataclass
class WaveletMatrix:
    n: int
    zeros: list[int]  # of each plane
    planes: list[np.ndarray]  # bytes of each plane, whole blocks, first bit highest
    ones: list[np.ndarray]  # of each plane, ones before each block and after the last

    @classmethod
    def of(cls, values: np.ndarray, bits: int = 16) -> WaveletMatrix:
        values = np.ascontiguousarray(values, dtype=np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ones = [], [], []
        for k in range(bits - 1, -1, -1):
            bit = (values >> k & 1).astype(bool)
            plane = np.packbits(bit)
            plane = np.concatenate([plane, np.zeros(-len(plane) % _BLOCK_BYTES, dtype=np.uint8)])
            counts = _ONES[plane].reshape(-1, _BLOCK_BYTES).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ones.append(np.concatenate([np.zeros(1, dtype=np.uint32), np.cumsum(counts, dtype=np.uint32)]))
            low = np.compress(~bit, values)  # much faster than indexing by a mask
            zeros.append(len(low))
            values = np.concatenate([low, np.compress(bit, values)])
        return cls(len(values), zeros, planes, ones)

    @classmethod
    def read(cls, n: int, zeros: list[int], planes: list[bytes], ones: list[bytes]) -> WaveletMatrix:
        return cls(n, zeros, [np.frombuffer(p, dtype=np.uint8) for p in planes], [np.frombuffer(o, dtype="<u4") for o in ones])

    @property
    def bits(self) -> int:
        return len(self.planes)

    def decode(self) -> np.ndarray:
        """All numbers in order: the planes are walked from the lowest up, each undoing its partition."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, dtype=kind)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            before = np.empty_like(values)
            before[np.flatnonzero(~bit)] = values[:zeros]
            before[np.flatnonzero(bit)] = values[zeros:] | kind(1 << k)
            values = before
        return values

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position (0 to n)."""
        block, rest = np.divmod(at, BLOCK_BITS)
        out = self.ones[k][block].astype(np.int64)
        inside = np.flatnonzero(rest)
        for a in range(0, len(inside), _LOT):
            i = inside[a : a + _LOT]
            held = np.unpackbits(self.planes[k].reshape(-1, _BLOCK_BYTES)[block[i]], axis=1)
            out[i] += (held * (np.arange(BLOCK_BITS) < rest[i, None])).sum(axis=1, dtype=np.int64)
        return out

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position in plane k of the nth (from 0) bit of that kind."""
        before = self.ones[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK_BITS - before
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), dtype=np.int64)
        for a in range(0, len(nth), _LOT):
            b, want = block[a : a + _LOT], nth[a : a + _LOT]
            held = np.unpackbits(self.planes[k].reshape(-1, _BLOCK_BYTES)[b], axis=1)
            seen = np.cumsum(held if bit else 1 - held, axis=1, dtype=np.int64)
            out[a : a + _LOT] = b * BLOCK_BITS + (seen <= (want - before[b])[:, None]).sum(axis=1)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some positions, a rank a plane each."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            bit = self.planes[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            ones = self._rank1(k, at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _range(self, value: int, until: int) -> tuple[int, int]:
        """Where the occurrences of value among the first ``until`` numbers stand below the last plane."""
        ends = np.array([0, until], dtype=np.int64)
        for k in range(self.bits):
            ones = self._rank1(k, ends)
            ends = self.zeros[k] + ones if value >> (self.bits - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, value: int, until: int | None = None) -> int:
        """Occurrences of value among the first ``until`` numbers."""
        if not 0 <= value < 1 << self.bits:
            return 0
        a, b = self._range(value, self.n if until is None else until)
        return b - a

    def occurrences(self, value: int) -> np.ndarray:
        """Positions of value, ascending: its range below the last plane, selected back up."""
        if not 0 <= value < 1 << self.bits:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(*self._range(value, self.n), dtype=np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at
