"""Operator 8: benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: positions marked 0 are ignored, so a substituted
word there does not hide a hit. Hashes of the benchmark's seeds are joined with those of the
documents; every hit's diagonal is then compared word by word, diagonals of one item and text are
also joined across inserted and missing words, and a document counts as contaminated when enough
words of an item agree in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _MUL, Slice, mix, slices

#: Fixed masks over 9 words, 6 of which count (5 in the last two, spread wider). One substitution
#: anywhere in 9 words leaves at least one seed whole.
MASKS = ("111111000", "000111111", "111000111", "110110110", "101101101", "011011011", "110101011", "101011110")
#: A stretch of aligned words counts if this share of it agrees.
SHARE = 0.8
#: So many words that agree in one stretch are a leak, however long the item is.
LEAK_WORDS = 13
#: Fewer are one if the stretch has this share of a short item's words, and at least so many agree.
LEAST_WORDS = 8
COVER = 0.6
#: What a word that agrees is worth to an alignment, and what a word skipped for it costs; more than
#: it is worth, so that no word of the text pays twice.
AGREES, SKIPS = 4, 5
#: Benchmark words that one pass over the documents looks for; more are taken in blocks.
BLOCK_WORDS = 1_000_000


class Seeds:
    """The seed hashes of some benchmark items: a sorted array, with item and position."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t or "" for _, t in items], pa.string())
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        words, bounds = [np.zeros(0, np.uint64)], [0]
        for s in slices(texts):
            words.append(s.hashes())
            bounds += (s.bounds[1:] + bounds[-1]).tolist()
        self.words, self.bounds = np.concatenate(words), np.array(bounds)
        row = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        keys, at = [], []
        for m, mask in enumerate(MASKS):
            k, ok = seed_hashes(self.words, row, mask, m)
            keys.append(k[ok])
            at.append(np.flatnonzero(ok))
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.row = row
        # items shorter than a mask are looked for whole
        self.short = [i for i in range(len(items)) if 0 < self.bounds[i + 1] - self.bounds[i] < len(MASKS[0])]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True


def seed_hashes(words: np.ndarray, row: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mask at each position, and whether the mask lies within one text."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, number + 1, dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * _MUL + words[j : j + n]
    return mix(h), row[:n] == row[len(mask) - 1 :]


#: Hits of seeds that are spread out at once; more are taken in turns.
HITS_AT_ONCE = 1 << 20


def _diagonals(words: np.ndarray, row: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, item row, text position - item position) of every seed that both have, each once.
    A hot word's hits are spread in bounded turns, so what is held is the diagonals."""
    width = len(words) + len(seeds.words) + 1
    found = [np.zeros(0, np.int64)]

    def spread(p: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        q = seeds.at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        p = np.repeat(p, n)
        # the diagonal's offset tells text and item apart but for their rows
        return np.unique((row[p] * np.int64(len(seeds.items)) + seeds.row[q]) * width + (p - q + len(seeds.words)))

    for m, mask in enumerate(MASKS):
        h, ok = seed_hashes(words, row, mask, m)
        may = np.flatnonzero(ok & seeds.filter[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(seeds.keys, h[may], "left"), np.searchsorted(seeds.keys, h[may], "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        cut = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), HITS_AT_ONCE), "right")
        for a, b in zip(cut, np.r_[cut[1:], len(n)][: len(cut)], strict=True):
            if b > a:
                found = [np.unique(np.concatenate([*found, spread(may[hit[a:b]], lo[hit[a:b]], n[a:b])]))]
    for i in seeds.short:
        a, b = seeds.bounds[i], seeds.bounds[i + 1]
        at = [p for p in np.flatnonzero(words[: len(words) - (b - a) + 1] == seeds.words[a]).tolist() if np.array_equal(words[p : p + b - a], seeds.words[a:b]) and row[p] == row[p + b - a - 1]]
        at = np.array(at, dtype=np.int64)
        found.append((row[at] * np.int64(len(seeds.items)) + i) * width + (at - int(a) + len(seeds.words)))
    keys = np.unique(np.concatenate(found))
    pair = keys // width
    return pair // len(seeds.items), pair % len(seeds.items), keys % width - len(seeds.words)


def _agreeing(words: np.ndarray, item: np.ndarray, low: int, high: int, shifts: np.ndarray) -> np.ndarray:
    """How many words of an item agree along each diagonal with the text words[low:high]."""
    total, step = np.zeros(len(shifts), np.int64), max(1, HITS_AT_ONCE // len(item))
    for a in range(0, len(shifts), step):
        at = shifts[a : a + step, None] + np.arange(len(item))
        total[a : a + step] = ((at >= low) & (at < high) & (words[np.clip(at, low, high - 1)] == item)).sum(axis=1)
    return total


def overlaps(words: np.ndarray, row: np.ndarray, bounds: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int, int]]:
    """(row, item, matched words, overlap) of the best diagonal, or path between diagonals, of each
    text and item that are contaminated."""
    rows, items, shifts_all = _diagonals(words, row, seeds)
    out = []
    cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])]) if len(rows) else []
    for lo, hi in zip(cut, [*cut[1:], len(rows)][: len(cut)], strict=True):
        r, i, shifts = int(rows[lo]), int(items[lo]), shifts_all[lo:hi]
        first, end = int(seeds.bounds[i]), int(seeds.bounds[i + 1])
        item, low, high = seeds.words[first:end], int(bounds[r]), int(bounds[r + 1])
        agree = _agreeing(words, item, low, high, shifts + first)
        best, runs = (0, 0), []
        for d in np.argsort(-agree, kind="stable").tolist():
            # no stretch has more agreeing words than its diagonal, nor more than the item
            if agree[d] < max(best[0], min(LEAST_WORDS, len(item))) or best == (len(item), len(item)):
                break
            shift = int(shifts[d])
            a, b = max(first, low - shift), min(end, high - shift)
            runs.append(best_run(words[a + shift : b + shift] == seeds.words[a:b]))
            best = max(best, runs[-1])
        if len(shifts) > 1 and best[0] < len(item):
            runs.append(best_run(aligned(item, words[low:high], shifts + first - low)))
        good = [x for x in runs if leaked(*x, len(item))]
        if good:
            out.append((r, int(seeds.items[i]), *max(good)))
    return out


def leaked(run: int, length: int, size: int) -> bool:
    """Whether ``run`` words that agree, of a stretch of ``length``, are a leak of an item of ``size``."""
    return run == length == size or run >= LEAK_WORDS or (run >= LEAST_WORDS and length >= COVER * size)


def best_run(same: np.ndarray) -> tuple[int, int]:
    """(matched, length) of the longest stretch with matched >= SHARE * length, without differences
    at its ends; of equally long ones that with the most matches."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    total = np.r_[0, np.cumsum(np.where(same, round(100 * (1 - SHARE)), -round(100 * SHARE)))]
    # for every match as begin the last match at whose end the total is not lower
    rest = np.maximum.accumulate(total[at + 1][::-1])
    end = len(at) - 1 - np.searchsorted(rest, total[at], "left")
    size = at[end] + 1 - at
    begin = max(np.flatnonzero(size == size.max()).tolist(), key=lambda k: end[k] - k)
    return int(end[begin]) - begin + 1, int(size[begin])


def aligned(item: np.ndarray, text: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Which words agree along the best path through the item that may change between the given
    diagonals (text position - item position, ascending); words of the text it skips disagree.

    The totals of every sqrt(n)-th word are kept and those between computed again on the way
    back, so that memory is sqrt(n) rows of a number a diagonal.
    """
    n, number = len(item), np.arange(len(shifts))

    def step(total: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The totals after word q, and which diagonal each came from."""
        best, source = total, number
        for way in (1, -1):
            v = (total + way * SKIPS * shifts)[::way]
            top = np.maximum.accumulate(v)
            origin = np.maximum.accumulate(np.where(np.r_[True, v[1:] > top[:-1]], number, 0))
            top, origin = top[::way] - way * SKIPS * shifts, (origin if way == 1 else len(shifts) - 1 - origin)[::way]
            best, source = np.maximum(best, top), np.where(top > best, origin, source)
        p = q + shifts
        inside = (p >= 0) & (p < len(text))
        return best + AGREES * (inside & (text[np.clip(p, 0, len(text) - 1)] == item[q])), source

    block = max(1, int(n**0.5))
    total, kept = np.zeros(len(shifts), np.int64), []
    for q in range(n):
        if q % block == 0:
            kept.append(total)
        total, _ = step(total, q)
    d, path = int(np.argmax(total)), np.zeros(n, np.int64)
    for k in range(len(kept) - 1, -1, -1):
        total, sources = kept[k], []
        for q in range(k * block, min(n, (k + 1) * block)):
            total, source = step(total, q)
            sources.append(source)
        for j in range(len(sources) - 1, -1, -1):
            path[k * block + j] = shifts[d]
            d = int(sources[j][d])
    out, last = [], -1
    for q, p in enumerate((np.arange(n) + path).tolist()):
        if q and path[q] > path[q - 1]:
            out += [False] * int(path[q] - path[q - 1])
        agrees = last < p < len(text) and bool(text[p] == item[q])
        out.append(agrees)
        last = p if agrees else last
    return np.array(out, dtype=bool)


def _scan(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                s: Slice
                words, row = s.hashes(), s.row_of_word()
                got = overlaps(words, row, s.bounds, seeds)
                ids = batch.column(0).slice(s.first, s.rows).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3))], ["doc_id", "item_id", "matched", "overlap"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about BLOCK_WORDS words, one on the driver at a time."""
    items, words = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        items.append((r[0], r[1]))
        words += len(r[1]) // 4
        if words >= BLOCK_WORDS:
            yield items
            items, words = [], 0
    if items:
        yield items


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, overlap): the best aligned overlap of each contaminated pair.

    The benchmark is the stated query set: it is taken in blocks of BLOCK_WORDS words, each
    compared with the whole texts of all documents. Null and blank texts and items match
    nothing. Items shorter than a mask match as a whole. Rows that repeat a doc_id count once.
    An empty benchmark or table gives no rows.
    """
    schema = "doc_id long, item_id long, matched long, overlap long"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark):
        found = found.unionByName(texts.mapInArrow(_scan(Seeds(items)), schema))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "overlap")).alias("m")).select("doc_id", "item_id", "m.matched", "m.overlap")


def _without(seeds: Seeds, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            for s in slices(batch.column(text)):
                for r in {g[0] for g in overlaps(s.hashes(), s.row_of_word(), s.bounds, seeds)}:
                    good[s.first + r] = False
            yield batch.filter(pa.array(good))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a contaminated overlap, with docs' columns.

    Each row is judged where it is, by its whole text, and passed on or not: nothing is joined or
    shuffled, and missing, repeated or clashing ids do no harm. Rows with null or blank texts stay.
    Blocks of a large benchmark follow each other, each over what the one before has left.
    """
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(_without(Seeds(items), docs.columns.index("text")), docs.schema)
    return docs
