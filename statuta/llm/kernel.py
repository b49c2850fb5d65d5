"""Words of whole texts as arrays of 64-bit hashes, vectorised over the bytes of a batch.

Used inside Arrow tasks; Spark deals out the rows. Nothing here holds more than a slice of a
batch (SLICE_BYTES, or one text where a text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    p = np.full(n, 0x100000001B3 * 2 + 1, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS = _powers(4096)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of the argument."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Slice:
    """Some rows of a batch: row numbers first..first+rows, the bytes of their texts and the words."""

    first: int
    rows: int
    data: np.ndarray  # bytes
    starts: np.ndarray  # of each word, in data
    lens: np.ndarray  # bytes of each word
    bounds: np.ndarray  # bounds[i]:bounds[i + 1] are the words of row i

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash for each word; lower folds A-Z."""
        global _POWERS
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        data = _LOWER[self.data] if lower else self.data
        inside = data[~_SPACE[data]]
        at = np.zeros(len(self.lens), dtype=np.int64)
        np.cumsum(self.lens[:-1], out=at[1:])
        k = np.arange(len(inside)) - np.repeat(at, self.lens)
        longest = int(self.lens.max())
        if longest > len(_POWERS):
            _POWERS = _powers(longest)
        return mix(np.add.reduceat(_BYTE[inside] * _POWERS[k], at) ^ (self.lens.astype(np.uint64) * _MUL))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of consecutive rows with about ``most`` bytes; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    texts = pa.concat_arrays([texts])
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield _slice(a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


def _slice(first: int, data: np.ndarray, off: np.ndarray) -> Slice:
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    lens = np.flatnonzero(ends) + 1 - starts
    return Slice(first, len(off) - 1, data, starts, lens, np.searchsorted(starts, off))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words, in order; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        out = mix(out * _MUL + h[j : len(h) - width + 1 + j])
    return out


def shingle_sets(s: Slice, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of the slice."""
    h = s.hashes()
    for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True):
        yield np.unique(shingles(h[a:b], width))
