"""Fill-in-the-middle, token ids and source divergence against plain models."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from statuta.llm import divergence, fill_middle, queries, token_ids
from statuta.llm.shared import bucketed
from statuta.llm.wavelet import WaveletMatrix
from tests.llm.helpers import AWKWARD, DDL, clash, docs

# --- fill in the middle


def fim(doc_id, text, percent=100, spm=50):
    """(n, form, prefix, middle, output) by plain slicing."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


LINES = [
    (20, "a\nb\nc\nd"), (21, "\n\n\n"), (22, "one <P> line\nmore"), (23, "esc\x1b0 \x1b1\x1e\n\x1e\x1e\nlast\x1b"), (24, "<\nS>\n<M\n>"), (25, "ü𝒳\n" * 50), (26, "line of text\n" * 20_000), (27, "\x00\n\x01"), (28, "no end"), (29, "$0 \\1\n$1"),
]


def test_fim_by_slices(spark):
    rows = [*AWKWARD, *LINES, *LINES, *((100 + k, "".join(f"l{j}\n" for j in range(k % 9))) for k in range(80))]
    d = clash(docs(spark, rows))
    want = Counter((r[0], *fim(r[0], r[1])) for r in rows)
    got = fill_middle.transform(d)
    assert Counter((r["doc_id"], r["fim_units"], r["fim_form"], r["fim_prefix"], r["fim_middle"], r["fim_output"]) for r in got.collect()) == want
    assert got.columns[: len(d.columns)] == d.columns
    back = got.select(F.coalesce("text", F.lit("")).alias("t"), fill_middle.restored(F.col("fim_output"), F.col("fim_form")).alias("b")).where("not (t <=> b)")
    assert back.isEmpty()
    forms = Counter(w[2] for w in want)
    assert forms["psm"] > 20 and forms["spm"] > 20


def test_fim_shares_and_clashing_names(spark):
    d = docs(spark, [(k, "a\nb\nc\n") for k in range(400)]).withColumn("fim_form", F.lit("mine")).withColumn("FIM_mark", F.lit(1))
    rows = fill_middle.transform(d, percent=25, spm_percent=0).collect()
    assert Counter(r["_fim_form"] for r in rows) == Counter(fim(k, "a\nb\nc\n", 25, 0)[1] for k in range(400))
    assert {r["fim_form"] for r in rows} == {"mine"}
    assert fill_middle.report(d.limit(0)).collect() == []


def test_fim_digests(spark):
    rows = [*AWKWARD, *LINES]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        n, form, p, m, out = fim(i, t)
        want[(i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or ""))] += 1
    assert Counter(map(tuple, fill_middle.report(docs(spark, rows)).collect())) == want


def test_fim_needs_no_shuffle(spark, sf_dir):
    plan = queries.op11_fill_middle(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- wavelet matrix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**11 - 1), max_size=1500), st.integers(11, 20))
def test_wavelet_matrix(values, bits):
    m = WaveletMatrix.of(np.array(values, dtype=np.int64), bits)
    assert m.decode().tolist() == values
    assert m.access(np.arange(len(values))).tolist() == values
    for v in {*values[:5], 0, 7, 2**11 - 1, 2**bits}:
        assert m.occurrences(v).tolist() == [i for i, x in enumerate(values) if x == v]
        assert m.count(v) == values.count(v) and m.count(v, len(values) // 2) == values[: len(values) // 2].count(v)


def test_wavelet_matrix_is_succinct():
    values = np.random.default_rng(1).integers(0, 50_000, 200_000)
    m = WaveletMatrix.of(values)
    assert sum(p.nbytes + o.nbytes for p, o in zip(m.planes, m.ones, strict=True)) < 1.1 * 2 * len(values)
    at = np.random.default_rng(2).integers(0, len(values), 3000)
    assert (m.access(at) == values[at]).all()
    v = int(values[17])
    assert (m.occurrences(v) == np.flatnonzero(values == v)).all()


# --- token ids


@pytest.fixture(scope="module")
def codec():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_ids.default_path())


def ids_of(codec, text):
    return [*codec.encode(text or "", add_special_tokens=False).ids, 2]


BLANKS = [
    "a b  c   d\n e \n\n f\t g", " lead and trail  ", "it's we'll  'tis ' s", "a\u00a0b \u00a0 c\u00a0 d", "x \u3000 y\u3000 z \u2003q", "tab\t tab", "naïve café — “quoted” text", "1 23 4a b5 !? #$ % x", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "\x1c \x1f a\x85 b", "日本 語 。 x",
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1'!s é\u00a0\u3000\u2003—\n\t\x1c\x85日"), max_size=30), min_size=1, max_size=4))
def test_pieces_have_the_ids_of_whole_texts(codec, texts):
    raw = [t.encode() for t in texts]
    got, stops = token_ids.Encoder(token_ids.default_path()).encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert [x.tolist() for x in np.split(got, stops[:-1])] == [ids_of(codec, t) for t in texts]


def digests_of(codec, rows):
    """In ascending id, null first; equal ids in any order that the result itself shows."""
    out, at = [], 0
    for i, t in rows:
        ids = np.array(ids_of(codec, t), dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_token_ids_awkward(spark, codec):
    rows = [*((r[0], r[1]) for r in AWKWARD), *((20 + k, t) for k, t in enumerate(BLANKS)), (20, BLANKS[0]), (5, "another text")]
    d = clash(docs(spark, rows))
    folder = token_ids.write(d, task_bytes=20_000, shard_tokens=3000)
    store = token_ids.shards(spark, folder)
    assert store.count() > 5
    got = sorted(map(tuple, token_ids.digests(store).collect()), key=lambda r: r[1])
    texts = {tuple(ids_of(codec, t)): t for _, t in rows}
    back = [(r["doc_id"], texts[tuple(r["ids"])]) for r in sorted(token_ids.documents(store.orderBy("shard")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]
    assert Counter((i, tuple(ids_of(codec, t))) for i, t in rows) == Counter((i, tuple(ids_of(codec, t))) for i, t in back)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in digests_of(codec, rows))
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got[:-1])]
    again = sorted(map(tuple, token_ids.digests(token_ids.shards(spark, token_ids.write(d, task_bytes=7_000))).collect()), key=lambda r: r[1])
    assert again == got


def test_token_ids_on_real_rows(spark, sf_dir, codec):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op12_token_ids(spark, sf_dir).collect())) == digests_of(codec, rows)


def test_token_store_lookups(spark, sf_dir, codec):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    store = token_ids.shards(spark, token_ids.write(d, task_bytes=30_000))
    rows = [(r["doc_id"], ids_of(codec, r["text"])) for r in d.orderBy("doc_id").collect()]
    flat = [x for _, ids in rows for x in ids]
    asked = [2, flat[5], flat[-2], 50_256]
    n = Counter()
    for r in token_ids.counts(store, asked).collect():
        n[r["id"]] += r["n"]
    assert n == {x: flat.count(x) for x in asked}
    found = defaultdict(set)
    for r in token_ids.occurrences(store, asked).collect():
        found[r["id"]].add((r["doc_id"], r["place"]))
    assert found == {x: s for x in asked if (s := {(i, k) for i, ids in rows for k, y in enumerate(ids) if x == y})}
    places = [0, 1, len(flat) - 1, len(flat) // 2, len(flat) // 3, len(flat), -1, 1]
    got = token_ids.access(store, spark.createDataFrame([(p,) for p in places], "place long"))
    assert sorted(map(tuple, got.collect())) == sorted({(p, flat[p]) for p in places if 0 <= p < len(flat)})


def test_token_ids_empty_and_other_keys(spark, codec):
    d = docs(spark, [(1, "a b"), (2, None)])
    assert token_ids.encode(d.limit(0)).collect() == []
    got = sorted(map(tuple, token_ids.encode(d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).collect()))
    assert got == [("k1", *digests_of(codec, [(1, "a b")])[0][1:]), ("k2", 3, 1, zlib.crc32(b"\2\0\0\0"))]
    with pytest.raises(Exception, match="does not fit"):
        token_ids.write(docs(spark, [(1, "unusual wording")]), bits=8)


# --- source divergence


def diverged(rows, least_docs, top=50):
    """The audit of (text, lang, source) rows by plain loops over whole numbers."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    cut = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")), la or "", so or "") for t, la, so in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, la, so in cut:
        df[la].update(set(terms))
        n[la, so].update(terms)
        groups[la].add(so)
    out = set()
    for la, sources in groups.items():
        kept = [t for t, k in df[la].items() if k >= least_docs]
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * v) for t in kept}  # noqa: B023

        whole = shares(sum((n[la, s] for s in sources), Counter()))
        p = {s: shares(n[la, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(whole[t] - p[s][t], t.encode(), t) for t in kept if n[la, s][t] and p[s][t] > whole[t]]
            out |= {(la, s, part, x, -f, k + 1) for part, items in (("pair", pairs), ("term", sorted(terms)[:top])) for k, (f, _, x) in enumerate(sorted(items))}
    return out


@pytest.mark.parametrize(("slice_counts", "block_groups"), [(1 << 14, 256), (5, 1)])
def test_divergence_by_loops(spark, slice_counts, block_groups):
    words = "alpha Beta gamma DELTA straße naïve x_y don't ÿ 日本 zeta".split()
    rows = [(" ".join(words[(i * k + j) % (5 + i % 7)] for j, k in enumerate(range(1, 3 + i % 20))), "de" if i % 3 else "en", f"s{i % 11}") for i in range(160)]
    rows += [(None, "en", "s0"), ("", None, None), ("alpha beta", None, None), ("alpha", None, "s1"), ("rare words only", "fr", "a"), ("other", "fr", None), ("1 2 3", "en", "no terms"), ("gamma " * 20_000, "de", "s3"), *[("alpha alpha", "de", "hot")] * 50]
    d = spark.createDataFrame([(k, t, la, so, 1) for k, (t, la, so) in enumerate(rows)], DDL)
    got = divergence.audit(clash(d), least_docs=4, top=6, slice_counts=slice_counts, block_groups=block_groups).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == diverged(rows, 4, 6)


def test_divergence_empty_and_without_terms(spark):
    d = docs(spark, [(1, "a"), (2, None, "t"), (3, "b", None)])
    assert divergence.audit(d.limit(0)).collect() == []
    assert set(map(tuple, divergence.audit(d).collect())) == diverged([("a", "en", "s"), (None, "en", "t"), ("b", "en", None)], 30)
    assert set(map(tuple, divergence.audit(d, least_docs=1).collect())) == diverged([("a", "en", "s"), (None, "en", "t"), ("b", "en", None)], 1)


def test_shares_are_exact():
    count = np.array([0, 1, 10**12, 8 * 10**15 - 10**6], dtype=np.int64)
    n, v = np.array([8 * 10**15]), 10**5
    assert divergence.shares(count, n, v).tolist() == [1 + 10**9 * (int(c) + 5) // (int(n[0]) + 5 * v) for c in count]


def test_round_moves_one_side_only(spark):
    """The resident side of a meeting keeps its partitions: one exchange, of what travels."""
    name, d = bucketed(spark.range(40).selectExpr("id % 4 as lang", "id % 5 as slice", "id as block"), ["lang", "slice", "block"], 6, "try")
    travelling = d.select("lang", "slice", ((F.col("block") + 1) % 40).alias("block"))
    met = d.hint("merge").join(travelling, ["lang", "slice", "block"])
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {name}")


def test_result_types(spark):
    d = docs(spark, [(1, "a")])
    kinds = dict(divergence.audit(d).dtypes)
    assert kinds["value"] == "bigint" and kinds["rank"] == "int"
    assert all(isinstance(f.dataType, LongType) and not isinstance(f.dataType, DoubleType) for f in token_ids.encode(d).schema.fields)


def test_pieces_of_the_slice_before_are_not_encoded_again():
    import numpy as np

    from statuta.llm import token_ids as t

    texts = ["red engines, and wings", "", "of red tanks. wings and", "and wings, red", " new  words"] * 3
    slices = [texts[k : k + 4] for k in range(0, len(texts), 4)]
    buffers = lambda some: (np.frombuffer("".join(some).encode(), np.uint8), np.r_[0, np.cumsum([len(x.encode()) for x in some])])
    one, asked = t.encoder_of(t.default_path()), []
    assert one is t.encoder_of(t.default_path())
    for some in slices:
        got, _ = one.encode(*buffers(some))
        assert got.tolist() == [i for x in some for i in (*one.codec.encode(x, add_special_tokens=False).ids, t.END)]
    ids = one._ids
    one._ids = lambda strings: asked.extend(strings) or ids(strings)
    try:
        got, _ = one.encode(*buffers(slices[-1]))
    finally:
        del one._ids
    assert not asked
    assert got.tolist() == [i for x in slices[-1] for i in (*one.codec.encode(x, add_special_tokens=False).ids, t.END)]
