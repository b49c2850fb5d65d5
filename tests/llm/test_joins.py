"""N-gram join and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.llm import decontamination as dc
from statuta.llm import ngram_join as nj
from statuta.llm import shared
from statuta.llm import signature_tree as tree
from statuta.llm.components import components
from tests.llm.helpers import AWKWARD, DDL, PLAIN, clash, docs, lower, words
from tests.llm.helpers import components as brute


def family_rows(seed=3):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(50):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"y{i}" for i in range(100 - k))) for k in range(30)]
    rows += [(3000 + k, " ".join(f"z{i}" for i in range(20))) for k in range(5)]
    return rows + [(4000, "one two"), (4001, "One TWO"), (4002, "one two three"), (4003, None), (4004, " ")]


@pytest.mark.parametrize(("width", "percent", "orders"), [(4, 85, 3), (5, 80, 3), (4, 85, 0), (5, 80, 0)])
def test_same_as_brute_force(spark, width, percent, orders):
    """orders=0: the groups find nothing, so step 4 alone must find every link."""
    rows = family_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.classes(docs(spark, rows), width, percent, orders).collect()}
    assert got == brute(rows, width, percent)


def test_real_rows(spark, sf_dir):
    from statuta.llm.queries import op10_ngram_join

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_ngram_join(spark, sf_dir).collect()} == brute(rows, 4, 85)


def test_small_groups_and_blocks(spark, monkeypatch):
    """Groups cut into parts give the same classes."""
    monkeypatch.setattr(nj, "GROUP_SETS", 4)
    monkeypatch.setattr(nj, "SMALL_BLOCK", 2)
    monkeypatch.setattr(nj, "GROUP_ROWS", 100)
    rows = family_rows(8)
    for orders in (1, 0):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.classes(docs(spark, rows), 4, 85, orders).collect()}
        assert got == brute(rows, 4, 85)


def test_hot_keys(spark, monkeypatch):
    """Keys joined from the broadcast table, by shuffle, or both, give the same."""
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(90)] + [(99, 0)], "key long, v long")
    keyed = rows.groupBy("key").count().withColumnRenamed("count", "members").where("members > 1")
    want = sorted(map(tuple, rows.join(keyed, "key").collect()))
    for most in (1 << 16, 8, 3, 1):
        monkeypatch.setattr(shared, "HOT_KEYS", most)
        assert sorted(map(tuple, shared.join_hot(rows, keyed, ["key"], 91).select("key", "v", "members").collect())) == want
    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    rows = family_rows(5)
    for orders in (1, 0):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.classes(docs(spark, rows), 4, 85, orders).collect()}
        assert got == brute(rows, 4, 85)
    edges = [(k, 0) for k in range(1, 40)] + [(50, 51), (51, 52)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(40), 0) | {50: 50, 51: 50, 52: 50}


def test_join_awkward(spark):
    d = clash(docs(spark, AWKWARD))
    out = nj.one_of_each(d)
    assert out.columns == d.columns
    ids = [r["doc_id"] for r in out.collect()]
    # one row of an id that repeats stays
    assert 6 not in ids and ids.count(5) == 1 and ids.count(None) == 2 and {1, 2, 3, 4, 8, 9, 10, 11} <= set(ids)
    assert {r["component_id"] for r in nj.classes(d).where("doc_id IS NULL").collect()} == {None}
    assert nj.classes(spark.createDataFrame([], DDL)).count() == 0


def test_ids_with_several_texts(spark):
    """An id is one node: its texts' classes are one component, of which one row stays."""
    a, b = PLAIN % (1, 1), " ".join(f"w{k}" for k in range(30))
    rows = [(2, b), (5, a), (5, b), (5, a), (9, a), (11, "alone here now")]
    d = clash(docs(spark, rows))
    assert {(r["doc_id"], r["component_id"]) for r in nj.classes(d).collect()} == {(2, 2), (5, 2), (9, 2), (11, 11)}
    assert sorted(r["doc_id"] for r in nj.one_of_each(d).collect()) == [2, 11]
    twice = clash(docs(spark, [(3, a), (3, a), (3, b)]))
    assert nj.one_of_each(twice).count() == 1


def test_without_broadcasts(spark, monkeypatch):
    """Operators that join, with no table small enough to broadcast and every second key hot."""
    from statuta.llm import licenses, mixing, sharding

    rows = family_rows(9)[::3] + [(r[0], r[1]) for r in AWKWARD] + [(7000 + k, PLAIN % (k, k)) for k in range(20)] + [(7100, "Released under the MIT License.\nmore")]
    d = clash(docs(spark, rows))
    f = d.select(F.concat_ws("/", "source", "doc_id").alias("path"), "text", (F.col("doc_id") == 7100).alias("is_licence_file"))
    every = {"one": lambda: nj.one_of_each(d), "mix": lambda: mixing.mix(d), "shard": lambda: sharding.shard(d, 3000), "licences": lambda: licenses.scan(spark, f)}
    want = {k: sorted(map(repr, q().collect())) for k, q in every.items()}
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    monkeypatch.setattr(shared, "BITMAP_BITS", 1 << 8)  # with false hits
    for k, q in every.items():
        assert sorted(map(repr, q().collect())) == want[k], k


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (41, 50), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {40: 40, 41: 40, 50: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


sets = st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=25), min_size=2, max_size=30)


@settings(max_examples=80, deadline=None)
@given(sets, st.sampled_from([50, 80, 85]))
def test_traversal_loses_no_link(many, percent):
    tokens = [np.unique(np.array(sorted(s), dtype=np.uint64)) for s in many]
    order = np.argsort([len(t) for t in tokens], kind="stable")
    tokens = [tokens[i] for i in order]
    levels = tree.build(tree.bitmaps(tokens, 64), np.array([len(t) for t in tokens]))
    found = {tuple(p) for p in tree.dual_traversal(levels, levels, percent).tolist()}
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens)):
            if tree.linked(tokens[i], tokens[j], percent):
                assert (i, j) in found
    other = tree.build(tree.bitmaps(tokens[:3], 64), np.array([len(t) for t in tokens[:3]]))
    across = {tuple(p) for p in tree.dual_traversal(levels, other, percent).tolist()}
    assert all((i, j) in across for i in range(len(tokens)) for j in range(len(tokens[:3])) if tree.linked(tokens[i], tokens[j], percent))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=200), st.sets(st.integers(0, 400), max_size=40), st.sampled_from([80, 85]))
def test_prefixes_share_enough(a, noise, percent):
    """Linked sets share at least needed() tokens within their prefixes."""
    x, y = np.array(sorted(a)), np.array(sorted(a ^ noise))
    if tree.linked(x.astype(np.uint64), y.astype(np.uint64), percent):
        px, py = (set(v[: int(nj.prefix_length(len(v), percent))].tolist()) for v in (x, y))
        assert len(px & py) >= max(int(nj.needed(len(x), percent)), int(nj.needed(len(y), percent)))


# --- decontamination


def hits_brute(rows, items):
    """Every diagonal of every pair, without seeds."""
    out = {}
    for i, t in rows:
        w = words(lower(t))
        for k, b in items:
            v, best = words(lower(b)), None
            for shift in range(-len(v) + 1, len(w)):
                a, e = max(0, -shift), min(len(v), len(w) - shift)
                if e <= a:
                    continue
                run, length = dc.best_run(np.array([w[p + shift] == v[p] for p in range(a, e)]))
                if run and (run == length == len(v) or (run >= dc.LEAST_WORDS and length >= dc.COVER * len(v))):
                    best = max(best or (0, 0), (run, length))
            if best:
                out[(i, k)] = best
    return out


def test_hits(spark):
    rng = random.Random(1)
    v = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(v, k=15 + k))) for k in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (53, " ".join(["rep"] * 20))]
    rows = []
    for k in range(60):
        w = rng.choices(v, k=40)
        part = words(items[k % 12][1])
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "sub"
        if k % 5 == 4:
            part = part[: len(part) // 3]
        rows.append((k, " ".join(w[:20] + part + w[20:])))
    rows += [(100, "a TINY Item b"), (101, None), (102, ""), (103, items[3][1]), (104, items[3][1])]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["overlap"]) for r in dc.hits(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = hits_brute(rows, items)
    assert {k for k in want if want[k][1] - want[k][0] <= 2} <= set(got) <= set(want)  # all with two substitutions or fewer
    assert all(got[k] == want[k] for k in got)
    assert {(100, 50), (103, 3), (104, 3)} <= set(got)


def test_hits_of_long_and_broken_items(spark):
    """A long passage is found however long its item is, and across substituted, inserted and
    missing words; a short phrase of a long item is not."""
    item = [f"q{i}" for i in range(100)]
    small = [f"s{i}" for i in range(38)]
    short = [f"t{i}" for i in range(20)]
    pad = [f"p{i}" for i in range(30)]
    cases = {
        1: item[20:79], 2: item[:13], 3: [w if k % 5 != 4 else "sub" for k, w in enumerate(small)], 4: [*small[:19], "new", *small[19:]], 5: small[:18] + small[19:],
        6: item[:12], 7: [*short[:7], "new", *short[7:14]], 8: short[:7] + short[8:15], 9: [x for k, w in enumerate(short) for x in (w, "new", "new")], 10: short[:7],
    }
    rows = [(k, " ".join(pad + w + pad)) for k, w in cases.items()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(small)), (3, " ".join(short))], "item_id long, text string")
    got = {r["doc_id"]: (r["matched"], r["overlap"]) for r in dc.hits(docs(spark, rows), bench).collect()}
    assert got == {1: (59, 59), 2: (13, 13), 3: (31, 38), 4: (38, 39), 5: (37, 38), 7: (14, 15), 8: (14, 15)}
    assert {r["doc_id"] for r in dc.clean(docs(spark, rows), bench).collect()} == {6, 9, 10}


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_with_many_substitutions(spark, share):
    """Against every diagonal of every pair: of overlaps with three substitutions and more nearly
    all are found, whatever their number."""
    rng = random.Random(int(share * 100))
    v = [f"v{i}" for i in range(5000)]
    items = [(k, " ".join(rng.choices(v, k=40))) for k in range(60)]
    rows = []
    for k, t in items:
        w = [x if rng.random() >= share else "sub" for x in t.split()]
        rows.append((k, " ".join(rng.choices(v, k=10) + w + rng.choices(v, k=10))))
    want = {k: n for k, n in hits_brute(rows, items).items() if n[1] - n[0] >= (3 if share > 0.05 else 0)}
    got = {(r["doc_id"], r["item_id"]) for r in dc.hits(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 20 and len(want.keys() & got) >= 0.97 * len(want)


def test_repetitive_texts_and_items():
    """Thousands of diagonals of one word: the same answer, without looking at each."""
    import time

    import pyarrow as pa

    from statuta.llm.kernel import slices

    texts = ["la " * 20_000 + "end", "la lo " * 3000, "la " * 11]
    [s] = slices(pa.array(texts), most=1 << 30)
    start = time.perf_counter()
    got = dc.overlaps(s.hashes(), s.row_of_word(), s.bounds, dc.Seeds([(1, "la " * 200), (2, "la lo " * 10 + "le")]))
    assert sorted(got) == [(0, 1, 200, 200), (1, 2, 20, 20)] and time.perf_counter() - start < 10


def test_aligned_uses_no_word_twice():
    of = lambda t: np.array([ord(c) for c in t])
    shifts = np.arange(-3, 4)
    assert dc.aligned(of("abbcdefgh"), of("abcdefgh"), shifts).sum() == 8
    assert dc.aligned(of("abcdefgh"), of("abcdxyefgh"), shifts).tolist() == [True] * 4 + [False] * 2 + [True] * 4


def test_one_substitution_leaves_a_seed():
    for at in range(len(dc.MASKS[0])):
        assert any(m[at] == "0" for m in dc.MASKS)


def test_clean(spark, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.first()["text"]
    d = clash(docs(spark, AWKWARD + [(90, "before " + item + " after"), (None, item), (91, PLAIN % (1, 1))]))
    out = dc.clean(d, bench)
    assert out.columns == d.columns and out.count() == len(AWKWARD) + 1
    assert dc.clean(d, bench.limit(0)).count() == len(AWKWARD) + 3
    assert dc.clean(spark.createDataFrame([], DDL), bench).count() == 0
    monkeypatch.setattr(dc, "BLOCK_WORDS", 50)  # several blocks find the same
    assert dc.clean(d, bench).count() == len(AWKWARD) + 1
