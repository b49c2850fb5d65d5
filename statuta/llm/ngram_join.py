"""Operator 10: n-gram Jaccard join with signature trees.

Sets are the distinct word shingles of whole texts. Two documents link when
100 * overlap >= percent * union; the result is exact (up to equal 64-bit hashes).

1. Equal sets are one class; only its smallest id goes on.
2. A set can link only if enough of its smallest tokens occur in another set. Tokens are dealt
   by hash, and sets that share too few drop out.
3. What is left is grouped by smallest token under several orders. Each group's signature tree
   is traversed against itself; links join components. Groups above GROUP_SETS are cut by
   another hash in each order, so that no task holds an unbounded group.
4. Step 2 again, between components: sets that could still link into another component are
   open. For these, every token of the prefix that two linking sets must share is a group; the
   traversal of its bitmaps leaves candidate pairs, which are checked on the sets.
Steps 3 and 4 join only what is not connected yet, so a group of near copies costs about one
comparison a member, not one a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signature_tree as st
from .components import components
from .kernel import mix, shingle_sets, slices
from .shared import free_name, join_hot, matched, staged

WIDTH, PERCENT = 5, 80
ORDERS = 3
GROUP_SETS = 256
GROUP_ROWS = 20_000
#: Tokens that a task holds before it deals them out.
DEALT_TOKENS = 500_000
#: Bits of the bitmaps that step 4 carries with each prefix token.
CARRIED_BITS = 2048


def least_overlap(n, percent: int):
    """A set of n tokens shares at least this many with any set it links to."""
    return (percent * n + 99) // 100


def wanted(n, percent: int):
    """Shared tokens that step 2 looks for in a set of n: its prefix is longer by as many."""
    return np.maximum(1, 3 * n * (100 - percent) // 300)


def prefix_length(n, percent: int):
    return n - least_overlap(n, percent) + wanted(n, percent)


def needed(n, percent: int):
    """Tokens of a set's prefix that lie in the prefix of any set it links to: what the smallest
    such set looks for, as wanted() grows with the size."""
    return wanted(least_overlap(n, percent), percent)


def _fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little")


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                n, fp = [], []
                for t in shingle_sets(s, width):
                    n.append(len(t))
                    fp.append(_fingerprint(t) if len(t) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.rows), pa.array(n, pa.int64()), pa.array(fp, pa.binary())], ["doc_id", "n", "fp"])

    return run


# --- step 2: which sets share enough tokens with other sets -----------------------------------


def _deal(tokens: np.ndarray, groups: np.ndarray, units: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed entries) of one slice. Tokens of three groups or more keep the entries of
    their smallest and largest group; the others' units are known to share and are counted."""
    order = np.lexsort((groups, tokens))
    t, g, u = tokens[order], groups[order], units[order]
    if not len(t):
        return
    begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    length = np.diff(np.r_[begin, len(t)])
    low, high = np.repeat(g[begin], length), np.repeat(g[begin + length - 1], length)
    known = (g != low) & (g != high)
    if known.any():
        ids, count = np.unique(u[known], return_counts=True)
        home = (ids % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(home):
            yield int(b), b"c" + np.stack([ids[home == b], count[home == b].astype(np.uint64)]).tobytes()
    t, g, u = t[~known], g[~known], u[~known]
    home = (mix(t) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    t, g, u, home = t[order], g[order], u[order], home[order]
    same = np.array_equal(g, u)
    cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(home)], strict=True):
        part = [t[a:b], g[a:b]] if same else [t[a:b], g[a:b], u[a:b]]
        yield int(home[a]), (b"2" if same else b"3") + np.stack(part).tobytes()


def _count_bucket(key, table):
    """(unit, shared): the number of a unit's tokens here that another group has too."""
    t, g, u, known = [], [], [], []
    for blob in table.column("blob").to_pylist():
        kind, a = blob[:1], np.frombuffer(blob, dtype=np.uint64, offset=1)
        if kind == b"c":
            known.append(a.reshape(2, -1))
            continue
        a = a.reshape(int(kind), -1)
        t.append(a[0])
        g.append(a[1])
        u.append(a[-1])
    ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in known:
        ids.append(k[0])
        counts.append(k[1].astype(np.int64))
    if t:
        t, g, u = map(np.concatenate, (t, g, u))
        order = np.lexsort((u, g, t))
        t, g, u = t[order], g[order], u[order]
        once = np.r_[True, (t[1:] != t[:-1]) | (u[1:] != u[:-1])]  # copies of a set in several slices
        t, g, u = t[once], g[once], u[once]
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[begin, len(t)])
        shared = np.repeat(g[begin] != g[begin + length - 1], length)
        one, n = np.unique(u[shared], return_counts=True)
        ids.append(one)
        counts.append(n)
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    return pa.table({"unit": pa.array(ids.view(np.int64)), "shared": pa.array(counts, pa.int64())})


def _count_shared(dealt: DataFrame) -> DataFrame:
    """(unit, shared) over all buckets of (bucket, blob)."""
    return dealt.groupBy("bucket").applyInArrow(_count_bucket, "unit long, shared long").groupBy("unit").agg(F.sum("shared").alias("shared"))


def _n_buckets(df: DataFrame) -> int:
    return max(8, 2 * df.rdd.getNumPartitions())


def _deal_texts(width: int, percent: int, buckets: int):
    def dealt(tokens: list[np.ndarray], groups: list[np.ndarray]) -> pa.RecordBatch:
        g = np.concatenate(groups)
        rows = list(_deal(np.concatenate(tokens), g, g, buckets))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, groups, seen, held = [], [], set(), 0
            for s in slices(batch.column(0)):
                for t in shingle_sets(s, width):
                    n = len(t)
                    g = _short(_fingerprint(t)) if n else 0
                    if n and g not in seen:  # copies within the batch deal once
                        seen.add(g)
                        p = int(prefix_length(n, percent))
                        tokens.append(t[:p])
                        groups.append(np.full(min(p, n), g, dtype=np.uint64))
                        held += p
                if held > DEALT_TOKENS:
                    yield dealt(tokens, groups)
                    tokens, groups, held = [], [], 0
            if tokens:
                yield dealt(tokens, groups)

    return run


def _deal_sets(percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, groups, units = [], [], []
            for doc, group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = np.frombuffer(blob, dtype=np.uint64)
                t = t[: int(prefix_length(len(t), percent))]
                tokens.append(t)
                groups.append(np.full(len(t), group, dtype=np.int64).view(np.uint64))
                units.append(np.full(len(t), doc, dtype=np.int64).view(np.uint64))
            if tokens:
                rows = list(_deal(np.concatenate(tokens), np.concatenate(groups), np.concatenate(units), buckets))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return run


# --- step 3: groups by smallest token ---------------------------------------------------------


def _order(tokens: np.ndarray, r: int) -> np.ndarray:
    return tokens if r == 0 else mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * r & 0xFFFFFFFFFFFFFFFF))


def _token_rows(width: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                sets = list(shingle_sets(s, width))
                keys = [[int(_order(t, r).min().view(np.int64)) for r in range(orders)] for t in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.first, s.rows), pa.array([len(t) for t in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([t.tobytes() for t in sets], pa.binary())], ["id", "n", "keys", "tokens"]
                )

    return run


def _link_group(percent: int):
    def run(key, table):
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        tokens = [np.frombuffer(b, dtype=np.uint64) for b in table.column("tokens").to_pylist()]
        root = np.array(st.link_group(tokens, percent), dtype=np.int64)
        moved = root != np.arange(len(root))
        return pa.table({"a": ids[moved], "b": ids[root[moved]]})

    return run


def _grouped_links(sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Links (a, b) within the groups of every order; a spanning forest of each."""
    light = sets.select("id", F.posexplode("keys").alias("r", "key"))
    sizes = light.groupBy("r", "key").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / F.lit(GROUP_SETS))
    cut = join_hot(light, sizes, ["r", "key"], orders * sets.count()).select("id", "r", "key", F.pmod(F.xxhash64("id", "r"), parts).cast("int").alias("part"))
    grouped = cut.join(sets.select("id", "tokens"), "id")
    return grouped.groupBy("r", "key", "part").applyInArrow(_link_group(percent), "a long, b long")


# --- step 4: what may still link between components -------------------------------------------


def _prefix_rows(percent: int):
    """(token, id, n, component, bits) for each token of the shortest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.frombuffer(batch.column(2)[k].as_py(), dtype=np.uint64)
                p = len(t) - int(least_overlap(len(t), percent)) + 1
                bits = st.bitmaps([t], CARRIED_BITS)[0].tobytes()
                ids, comp = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[:p].view(np.int64)), pa.array([ids] * p, pa.int64()), pa.array([len(t)] * p, pa.int64()), pa.array([comp] * p, pa.int64()), pa.array([bits] * p, pa.binary())], ["token", "id", "n", "component", "bits"]
                )

    return run


#: Blocks of up to so many sets are compared at their leaves, without a tree over them.
SMALL_BLOCK = 32


def _block_pairs(x: slice, y: slice, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, lost: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of row numbers of different components that the bounds leave, from x and y; x is y:
    each pair of x once."""
    same = x == y
    if max(x.stop - x.start, y.stop - y.start) <= SMALL_BLOCK:
        a, b = np.triu_indices(x.stop - x.start, 1) if same else (v.ravel() for v in np.indices((x.stop - x.start, y.stop - y.start)))
        a, b = a + x.start, b + y.start
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        leaves = st.Level(bits, n, n, lost)
        keep = st._may_link(leaves, a, leaves, b, percent)
        return np.stack([a[keep], b[keep]], axis=1)
    tree = st.build(bits[x], n[x])
    pairs = st.dual_traversal(tree, tree if same else st.build(bits[y], n[y]), percent) + np.array([x.start, y.start])
    return pairs[comp[pairs[:, 0]] != comp[pairs[:, 1]]]


def _candidates(percent: int):
    """Pairs of different components over the (token, i, j) blocks of one group of blocks."""

    def run(key, table):
        token, i, j, side, n, comp, ids = (table.column(c).to_numpy() for c in ("token", "i", "j", "side", "n", "component", "id"))
        order = np.lexsort((n, comp, side, j, i, token))  # like sets stand together in a block
        token, i, j, side, n, comp, ids = (v[order] for v in (token, i, j, side, n, comp, ids))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(order), -1)[order]
        lost = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        cut = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        found = [np.zeros((0, 2), dtype=np.int64)]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            if i[a] == j[a]:
                found.append(_block_pairs(slice(a, b), slice(a, b), ids, comp, n, bits, lost, percent))
            elif side[a] != side[b - 1]:
                middle = a + int(np.searchsorted(side[a:b], 1))
                found.append(_block_pairs(slice(a, middle), slice(middle, b), ids, comp, n, bits, lost, percent))
        pairs = ids[np.concatenate(found)]
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            ok = [st.linked(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _open_links(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links between different components that step 3 has not found. sets: (id, n, tokens)."""
    placed = sets.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "tokens", "n")
    buckets = _n_buckets(sets)
    shared = _count_shared(placed.select("id", "component", "tokens").mapInArrow(_deal_sets(percent, buckets), "bucket int, blob binary"))
    need = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(3 * (100 - percent)) * F.floor((F.lit(percent) * F.col("n") + 99) / 100) / 300))
    alive = staged(placed.join(shared, placed["id"] == shared["unit"]).where(F.col("shared") >= need).select("id", "component", "tokens"), "open")
    if alive.isEmpty():
        return alive.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    rows = alive.mapInArrow(_prefix_rows(percent), "token long, id long, n long, component long, bits binary")
    rows = staged(rows, "open-prefixes")
    total = rows.count()
    groups = max(1, total // GROUP_ROWS)
    sizes = rows.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", "members", F.ceil(F.col("members") / F.lit(4 * GROUP_SETS)).cast("int").alias("parts"))
    rows = join_hot(rows, sizes, ["token"], total).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a set goes to every pair of blocks that its block is in
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j"), (F.col("part") > q).cast("int").alias("side"))))
    rows = rows.withColumn("p", pair).select("token", "p.i", "p.j", "p.side", "id", "n", "component", "bits")
    # many small blocks a call: a block has at most two parts, a group about GROUP_ROWS rows
    rows = rows.withColumn("group", F.pmod(F.xxhash64("token", "i", "j"), F.lit(groups)))
    found = staged(rows.groupBy("group").applyInArrow(_candidates(percent), "a long, b long").distinct(), "candidates")
    tokens = alive.select("id", "tokens")
    both = found.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    component_id is the smallest doc_id that links reach, the row's own if there is none. A
    text with fewer words than ``width`` is one shingle; null and blank texts have none and
    link with nothing. Rows that repeat a doc_id are one node. Rows without a doc_id link with
    nothing and have a null component. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(texts.mapInArrow(_set_rows(width), "doc_id long, n long, fp binary"), "sets")
    known = sets.where("fp is not null and doc_id is not null")
    first = staged(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("members")), "classes")
    dealt = texts.where("doc_id is not null").select("text").mapInArrow(_deal_texts(width, percent, _n_buckets(texts)), "bucket int, blob binary")
    shared = _count_shared(dealt)
    need = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(3 * (100 - percent)) * F.floor((F.lit(percent) * F.col("n") + 99) / 100) / 300))
    alive = first.join(shared, _short_column() == shared["unit"]).where(F.col("shared") >= need).select(F.col("rep").alias("id")).distinct()
    rest = matched(texts, F.col("doc_id"), staged(alive, "alive"), "left_semi")
    tokens = staged(rest.mapInArrow(_token_rows(width, orders), "id long, n long, keys array<long>, tokens binary").where("n > 0"), "tokens")
    links = staged(_grouped_links(tokens, percent, orders).unionByName(_one_node(known, first)), "links")
    comp = staged(components(links), "components")
    more = staged(_open_links(tokens.select("id", "n", "tokens"), comp, percent), "open-links")
    if not more.isEmpty():
        comp = staged(components(links.union(more)), "components")
    placed = first.join(comp, first["rep"] == comp["id"], "left").select("fp", "members", F.coalesce("component", "rep").alias("component"), F.col("component").isNotNull().alias("linked"))
    # a text of its own that links with nothing needs no partner
    placed = placed.where("linked or members > 1").drop("linked")
    found = join_hot(known, placed, ["fp"], known.count(), how="left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    alone = sets.where("fp is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _one_node(known: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of an id with several texts, as its rows are one node."""
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select(F.col("doc_id").alias("several"))
    some = matched(known, F.col("doc_id"), staged(several, "several-texts"), "left_semi").select("doc_id", "fp").distinct()
    return some.join(first.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _short_column():
    """_short() of the column fp: its first eight bytes, little end first, as a long."""
    h = F.hex(F.substring("fp", 1, 8))
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, -10).cast("long")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, one row an id; rows without an
    id stay. Of rows that repeat an id the one with the smallest hash stays."""
    c = classes(docs, width, percent)
    c = staged(c.where("doc_id is not null"), "classes-of-rows")
    [drop, again] = free_name(docs, "join_drop", "join_again")
    gone = staged(c.where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct(), "copies")
    key = F.col("doc_id").cast("long")
    kept = matched(docs, key, gone, "left_anti")
    twice = staged(c.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)), "repeats")
    if twice.isEmpty():
        return kept
    rows = matched(kept, key, twice, "left_semi").select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), key.alias("id"))
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    one = rows.groupBy("id").agg(F.min_by("row", order).alias("row")).select("row.*")
    return matched(kept, key, twice, "left_anti").unionByName(one)
