"""Operator 13: source divergence audit by systolic rotation.

How far the term frequencies of a language's sources are from each other and from the language
as a whole. Terms are counted per group of language and source and cut into slices; the groups of a
language are dealt to blocks. One row holds a block's counts in a slice, compressed, and stays in
its partition; a copy of it travels. In each round of the tournament every travelling block
moves to the partition of another, where the two meet and both directions of all their groups'
divergences come out. A ring of B blocks needs B / 2 rounds, and no round holds more than one copy of
the table in flight. Each resident row ranks its groups' terms in a bounded heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucketed, staged

#: A language keeps the terms that stand in so many of its documents.
LEAST_DOCS = 30
#: Shares are counted in billionths; PRIOR is added to each count.
SCALE, PRIOR = 10**9, 5
TOP_TERMS = 50
#: Counts in a slice on average, groups in a block, and blocks of a ring at least.
SLICE_COUNTS, BLOCK_GROUPS, LEAST_BLOCKS = 1 << 16, 256, 8
#: Partitions in which a ring's rows stay, at most.
MOST_BUCKETS = 8192
#: Bytes of text cut into terms at a time; terms and counts a task gathers before it hands them on.
SLICE_BYTES, HELD_TERMS, HELD_COUNTS = 4 << 20, 300_000, 1_000_000
#: Terms compared at a time.
_LOT = 1024

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = "lang string, source string, term string, n long, docs long"
_SLICES = "lang string, slice int, block int, v long, sources array<string>, ns array<long>, terms array<string>, totals array<long>, counts binary"


class _Tally:
    """Occurrences and documents of terms by group, under numbers; the terms are remembered once a task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.key = self.n = self.docs = np.zeros(0, dtype=np.int64)

    def add(self, lang: list[str], source: list[str], data: np.ndarray, off: np.ndarray) -> None:
        """Text i of a slice is data[off[i]:off[i + 1]]."""
        letter = _LETTER[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1] | edge[1:-1]
        ends[:-1] &= ~letter[1:] | edge[1:-1]
        starts = np.flatnonzero(begins)
        lens = np.flatnonzero(ends) + 1 - starts
        inside = _LOWER[np.compress(letter, data)]
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, np.cumsum(lens)].astype(np.int64)), pa.py_buffer(inside)).dictionary_encode()
        known = self.terms
        number = np.fromiter((known.setdefault(t, len(known)) for t in cut.dictionary.to_pylist()), dtype=np.int64, count=len(cut.dictionary))
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(lang, source, strict=True)), dtype=np.int64, count=len(lang))
        row = np.repeat(np.arange(len(lang)), np.diff(np.searchsorted(starts, off)))
        kinds = max(1, len(number))
        pair, n = np.unique(row * kinds + cut.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(pair, kinds)
        self._sum(np.r_[self.key, group[row] << 32 | number[term]], np.r_[self.n, n], np.r_[self.docs, np.ones_like(n)])

    def _sum(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        self.key = key[first]
        self.n, self.docs = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs))

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or len(self.key) > HELD_COUNTS

    def drain(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of what is held, then nothing is."""
        terms = pa.array(list(self.terms), pa.string())
        lang, source = (pa.array([g[i] for g in self.groups], pa.string()) for i in range(2))
        for a in range(0, len(self.key), 1 << 16):
            part = slice(a, a + (1 << 16))
            group = pa.array(self.key[part] >> 32)
            yield pa.record_batch([lang.take(group), source.take(group), terms.take(pa.array(self.key[part] & 0xFFFFFFFF)), pa.array(self.n[part]), pa.array(self.docs[part])], ["lang", "source", "term", "n", "docs"])
        self.__init__()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows (lang, source, text), in bounded memory."""
    tally = _Tally()
    for batch in batches:
        texts = pa.concat_arrays([batch.column(2).cast(pa.large_string())])
        _, off, data = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
            tally.add(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), data[off[a] : off[b]], off[a : b + 1] - off[a])
            a = b
            if tally.full():
                yield from tally.drain()
    yield from tally.drain()


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(a.astype("<i8").tobytes() for a in arrays)]), 1)


def _unpack(blob: bytes | None) -> list[np.ndarray]:
    """place in the row's sources, number of the term in the slice, its count; in that order."""
    if blob is None:
        return [np.zeros(0, dtype=np.int64)] * 3
    raw = np.frombuffer(zlib.decompress(blob), dtype="<i8")
    return np.split(raw[3:], np.cumsum(raw[:2]))


def _cut(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice of a language's kept terms, numbered in UTF-8 order: a row for each block."""
    t = pa.Table.from_batches(batches)
    terms = t["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(terms.dictionary.cast(pa.binary())).to_numpy()
    names = terms.dictionary.take(pa.array(order))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    term, block, n = number[terms.indices.to_numpy()], t["block"].to_numpy(), t["n"].to_numpy()
    totals = np.empty(len(order), dtype=np.int64)
    totals[term] = t["total"].to_numpy()
    source = t["source"].combine_chunks().dictionary_encode()
    place = source.indices.to_numpy()
    for b in np.unique(block).tolist():
        i = np.flatnonzero(block == b)
        mine, local = np.unique(place[i], return_inverse=True)
        ns = np.zeros(len(mine), dtype=np.int64)
        np.add.at(ns, local, n[i])
        own = np.unique(term[i])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.record_batch(
            [
                pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([b], pa.int32()), pa.array([len(order)], pa.int64()), one(source.dictionary.take(pa.array(mine))), one(pa.array(ns)),
                one(names.take(pa.array(own))), one(pa.array(totals[own])), pa.array([_pack(local, term[i], n[i])], pa.binary()),
            ],
            ["lang", "slice", "block", "v", "sources", "ns", "terms", "totals", "counts"],
        )


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR * v)), exact while n + PRIOR * v is below 2 ** 53:
    a long division by thousands, so that no step passes 64 bits."""
    under = n + PRIOR * v
    out, rest = np.divmod(count + PRIOR, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + digit
    return 1 + out


class _Block:
    """The groups of a block in a slice, ready to be compared."""

    def __init__(self, members: list[dict], sources: list[str] | None, blob: bytes | None, v: int):
        self.names = [m["source"] for m in members]
        self.n = np.array([m["n"] for m in members], dtype=np.int64)
        self.v = v  # kept terms of the language
        at = {s: i for i, s in enumerate(self.names)}
        place, self.term, self.count = _unpack(blob)
        self.place = np.array([at[s] for s in sources or ()], dtype=np.int64)[place] if len(place) else place
        order = np.argsort(self.term, kind="stable")
        self.place, self.term, self.count = self.place[order], self.term[order], self.count[order]

    def shares(self, a: int, b: int) -> np.ndarray:
        """Of each group (row) for the terms numbered a to b."""
        i = slice(*np.searchsorted(self.term, [a, b]))
        counts = np.zeros((len(self.n), b - a), dtype=np.int64)
        counts[self.place[i], self.term[i] - a] = self.count[i]
        return shares(counts, self.n[:, None], self.v)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over the terms of a slice, both directions of every two groups that meet."""
    for batch in batches:
        for r in batch.to_pylist():
            own = _Block(r["members"], r["sources"], r["counts"], r["kept"])
            peer = own if r["block"] == r["peer_block"] else _Block(r["peer_members"], r["peer_sources"], r["peer_counts"], r["kept"])
            out = np.zeros((len(own.names), len(peer.names)), dtype=np.int64)
            for a in range(0, r["v"], _LOT):
                b = min(r["v"], a + _LOT)
                p = own.shares(a, b)
                q = p if peer is own else peer.shares(a, b)
                for i in range(len(p)):
                    out[i] += np.abs(q - p[i]).sum(axis=1)
            i, j = np.indices(out.shape)
            apart = i != j if peer is own else i >= 0
            i, j, value = i[apart], j[apart], out[apart]
            left, right = pa.array(own.names, pa.string()).take(pa.array(i)), pa.array(peer.names, pa.string()).take(pa.array(j))
            lang = pa.array([r["lang"]] * len(value), pa.string())
            yield pa.record_batch([lang, left, right, pa.array(value)], ["lang", "source", "item", "value"])
            if peer is not own:
                yield pa.record_batch([lang, right, left, pa.array(value)], ["lang", "source", "item", "value"])


def _heaps(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The top terms of each group in a slice that are more frequent there than in the language."""
        for batch in batches:
            for r in batch.to_pylist():
                place, term, count = _unpack(r["counts"])
                own, local = np.unique(term, return_inverse=True)
                n = {m["source"]: m["n"] for m in r["members"]}
                q = shares(np.array(r["totals"], dtype=np.int64), np.array([r["n_lang"]]), r["kept"])
                for i, source in enumerate(r["sources"]):
                    at = place == i
                    value = shares(count[at], np.array([n[source]]), r["kept"]) - q[local[at]]
                    over = value > 0
                    best = heapq.nsmallest(top, zip((-value[over]).tolist(), local[at][over].tolist(), strict=True))  # numbers of terms follow UTF-8 order
                    k = len(best)
                    yield pa.record_batch([pa.array([r["lang"]] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([r["terms"][t] for _, t in best], pa.string()), pa.array([-f for f, _ in best], pa.int64())], ["lang", "source", "item", "value"])

    return run


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, slice_counts: int = SLICE_COUNTS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of docs.

    Part ``pair``: every other source of the language, the sum of the differences of all kept terms'
    shares. Part ``term``: the top terms whose share in the group is above the language's. Null
    text, lang and source count as ''. Terms are runs of letters A-Z, a-z and of characters beyond
    ASCII; a text of any length is cut whole, one row in memory. Repeated rows count as often as they
    come. Groups without terms and languages without kept terms are there with their smoothed
    shares, or 0. An empty table gives no rows. Ties go by UTF-8 order. Other columns are not read.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    # dealt by term, so that groups, and then languages, are summed where their rows are
    counts = rows.mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs")).where(F.col("docs") >= least_docs)
    counts = staged(counts.drop("docs"), "term-counts")
    groups = staged(rows.groupBy("lang", "source").count(), "term-groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-most // block_groups))
    n_slices = max(1, -(-counts.count() // slice_counts))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    # 1. slices of a language's terms, cut into blocks of groups
    dealt = counts.select("lang", F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int").alias("slice"), block, "source", "term", "n", "total")
    cut = staged(dealt.groupBy("lang", "slice").applyInArrow(_cut, _SLICES), "term-slices")
    # 2. sizes of groups and languages; one row a group, one a block
    slices = cut.groupBy("lang", "slice").agg(F.max("v").alias("v"))
    kept = slices.groupBy("lang").agg(F.sum("v").alias("kept"))
    sums = cut.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.ns").alias("n"))
    sized = groups.select("lang", "source", block).join(sums, ["lang", "source"], "left").select("lang", "block", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("m"))
    members = sized.groupBy("lang", "block").agg(F.sort_array(F.collect_list("m")).alias("members"), F.sum("m.n").alias("n_block"))
    members = members.withColumn("n_lang", F.sum("n_block").over(Window.partitionBy("lang"))).join(kept, "lang", "left")
    members = staged(members.select("lang", "block", "members", "n_lang", F.coalesce("kept", F.lit(0)).alias("kept")), "term-members")
    # 3. the ring: every block of a language in each of its slices, and in one without terms, which lists all pairs
    every = members.join(slices.unionByName(members.select("lang", F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("v")).distinct()), "lang")
    ring = every.join(cut.select("lang", "slice", "block", "sources", "counts"), ["lang", "slice", "block"], "left")
    name, resident = bucketed(ring, ["lang", "slice", "block"], min(MOST_BUCKETS, max(LEAST_BLOCKS, n_slices)), "ring")
    out = None
    for r in range(blocks // 2 + 1):
        peers = [F.col("block").alias("peer_block"), *(F.col(c).alias(f"peer_{c}") for c in ("members", "sources", "counts"))]
        travelling = resident.select("lang", "slice", ((F.col("block") + r) % blocks).alias("block"), *peers)
        met = resident.join(travelling, ["lang", "slice", "block"])
        if 2 * r == blocks:  # two blocks face each other; they meet once
            met = met.where("block < peer_block")
        met = met.select("lang", "slice", "block", "v", "members", "kept", "sources", "counts", "peer_block", "peer_members", "peer_sources", "peer_counts")
        sums = met.mapInArrow(_met, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        sums = staged(sums, f"term-round-{r}")
        out = sums if out is None else out.unionByName(sums)
    spark.sql(f"DROP TABLE {name}")
    pairs = out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # 4. local heaps, then the best of each group
    local = cut.join(members, ["lang", "block"]).select("lang", "sources", "terms", "totals", "counts", "members", "n_lang", "kept").mapInArrow(_heaps(top), "lang string, source string, item string, value long")
    return _ranked(pairs, "pair").unionByName(_ranked(local, "term").where(F.col("rank") <= top))
