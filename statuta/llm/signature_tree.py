"""Signature trees over sets of 64-bit tokens, and their dual traversal.

A leaf is a set's bitmap; a node above holds the OR of its children's bitmaps, the range of
their sizes and the most tokens that any of them loses to shared bits. Two nodes are followed
only while the largest overlap that any pair below them can have may still make a link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Node pairs whose bitmaps are held at once.
CHUNK_WORDS = 1 << 20


def bitmap_bits(sizes: np.ndarray) -> int:
    """A width that leaves typical sets of a group sparse."""
    want = 4 * int(np.median(sizes)) if len(sizes) else 256
    return 1 << min(16, max(8, want.bit_length()))


def bitmaps(tokens: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of bits / 64 words for each set."""
    out = np.zeros((len(tokens), bits // 64), dtype=np.uint64)
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    if len(row):
        at = np.concatenate(tokens) & np.uint64(bits - 1)
        np.bitwise_or.at(out, (row, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


@dataclass
class Level:
    bits: np.ndarray  # OR of what is below
    least: np.ndarray  # sizes below
    most: np.ndarray
    lost: np.ndarray  # max over sets below of size - bits set


def build(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the leaves to the root; rows must be ordered so that like sets are near."""
    sizes = sizes.astype(np.int64)
    levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].least) > 1:
        low = levels[-1]
        at = np.arange(0, len(low.least), FANOUT)
        levels.append(Level(np.bitwise_or.reduceat(low.bits, at, axis=0), np.minimum.reduceat(low.least, at), np.maximum.reduceat(low.most, at), np.maximum.reduceat(low.lost, at)))
    return levels


def _may_link(x: Level, a: np.ndarray, y: Level, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair below nodes a of x and b of y can have 100 * overlap >= percent * union."""
    ok = (100 * x.most[a] >= percent * y.least[b]) & (100 * y.most[b] >= percent * x.least[a])
    at = np.flatnonzero(ok)
    step = max(1, CHUNK_WORDS // max(1, x.bits.shape[1]))
    for k in range(0, len(at), step):
        i = at[k : k + step]
        shared = np.bitwise_count(x.bits[a[i]] & y.bits[b[i]]).sum(axis=1, dtype=np.int64)
        top = np.minimum(shared + np.minimum(x.lost[a[i]], y.lost[b[i]]), np.minimum(x.most[a[i]], y.most[b[i]]))
        ok[i] = (100 + percent) * top >= percent * (x.least[a[i]] + y.least[b[i]])
    return ok


def dual_traversal(x: list[Level], y: list[Level], percent: int) -> np.ndarray:
    """Pairs (leaf of x, leaf of y) that the bounds leave; with x is y each pair once, i < j."""
    same = x is y
    depth = max(len(x), len(y)) - 1
    a = b = np.zeros(1, dtype=np.int64)
    for level in range(depth, -1, -1):
        u, v = x[min(level, len(x) - 1)], y[min(level, len(y) - 1)]
        if level < depth:
            a, b = _children(a, b, len(u.least) if level < len(x) - 1 else 0, len(v.least) if level < len(y) - 1 else 0)
        if same:
            keep = a <= b if level else a < b
            a, b = a[keep], b[keep]
        keep = _may_link(u, a, v, b, percent)
        a, b = a[keep], b[keep]
    if same and depth == 0:
        return np.zeros((0, 2), dtype=np.int64)
    return np.stack([a, b], axis=1)


def _children(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; n or m 0: that side stays, its tree being lower."""
    if n:
        a, b = np.repeat(a, FANOUT) * FANOUT + np.tile(np.arange(FANOUT), len(a)), np.repeat(b, FANOUT)
        a, b = a[a < n], b[a < n]
    if m:
        a, b = np.repeat(a, FANOUT), np.repeat(b, FANOUT) * FANOUT + np.tile(np.arange(FANOUT), len(b))
        a, b = a[b < m], b[b < m]
    return a, b


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common tokens of two sorted arrays of distinct tokens."""
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The definition: 100 * overlap >= percent * union, both sets with a token."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    n = overlap(x, y)
    return 100 * n >= percent * (len(x) + len(y) - n)


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def link_group(tokens: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component within the group.

    Pairs come from the dual traversal; those already connected are not compared again.
    """
    sizes = np.array([len(t) for t in tokens])
    second = np.array([t[1] if len(t) > 1 else 0 for t in tokens], dtype=np.uint64)
    order = np.lexsort((sizes, second))  # families of near copies stand together
    bits = bitmap_bits(sizes)
    tree = build(bitmaps([tokens[i] for i in order], bits), sizes[order])
    forest = Forest(len(tokens))
    for i, j in dual_traversal(tree, tree, percent).tolist():
        i, j = int(order[i]), int(order[j])
        if forest.root(i) != forest.root(j) and linked(tokens[i], tokens[j], percent):
            forest.join(i, j)
    return [forest.root(i) for i in range(len(tokens))]
