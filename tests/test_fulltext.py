"""Stems, postings, questions and cover density against plain models."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from statuta.functions import english as en
from statuta.operators import fulltext as ft

# Sample pairs of the published description of the stemmer.
SAMPLES = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori
conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight knitted knit knives knive knocker knocker
hopping hop hoped hope skies sky dying die flies fli dies die relational relat conditional condit vietnamization vietnam sensitivity sensit formative format electrical electr adjustable adjust
replacement replac adoption adopt effective effect controlling control generously generous communication communic happy happi say say by by enjoy enjoy yellow yellow"""


def test_published_stems():
    w = SAMPLES.split()
    assert [en.stem(x) for x in w[::2]] == w[1::2]
    assert en.stem("a320s") == "a320s" and en.lexeme("the") is None and len(set(en.STOP_WORDS)) == 127


def terms(text):
    """[(term, position)] of a text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [(en.stem(w), k + 1) for k, w in enumerate(words) if w not in en.STOP_WORDS]


def spans(text, operand):
    at = set(terms(text))
    return [(p - o, p - o + operand.width - 1) for (t, o) in operand.terms[:1] for (x, p) in at if x == t if all((y, p - o + q) in at for y, q in operand.terms)]


def density(text, groups):
    """Sum over minimal stretches, found by trying every pair of a begin and an end."""
    total = None
    for g in groups:
        wanted = [sorted(spans(text, o)) for yes, o in g if yes]
        if any(spans(text, o) for yes, o in g if not yes) or not all(wanted):
            continue
        every = sorted({x for w in wanted for x in w})
        fits = [(s, e) for s in {x for x, _ in every} for e in {x for _, x in every} if all(any(s <= a and b <= e for a, b in w) for w in wanted)]
        least = [(s, e) for s, e in fits if not any((a, b) != (s, e) and s <= a and b <= e for a, b in fits)]
        filled = [x for w in wanted for x in w]
        total = (total or 0) + sum(0.1 / (1 + max(0, e - s + 1 - sum(b - a + 1 for a, b in filled if s <= a and b <= e))) for s, e in least)
    return total


QUESTIONS = ["red engines", "engine wing or tanks", '"red engine"', '"engine of the wing" tank', "wing -red", '-"red wing" wing engine or blue', "25.101", "of the", "wings winged winging", "red red wing", 'tank or tank wing or "blue blue"']


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(5)
    words = "red Engine engines wing, winged the of Tank 25.101 blue. 101 25 zzz".split()
    rows = [(f"n{k}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), " ".join(rng.choice(words) for _ in range(3))) for k in range(120)]
    rows += [("null", None, None), ("empty", "", " "), ("long", "zzz " * 20_000 + "red engine", "x"), ("accents", "Élan naïve ÉLANS", None)]
    return spark.createDataFrame(rows, "node_id string, content_text string, title string"), rows


@pytest.mark.parametrize("question", QUESTIONS)
def test_search_by_trying_all_stretches(nodes, question):
    df, rows = nodes
    groups = ft.parsed(question)
    want = {}
    for i, text, title in rows:
        found = [d for d in (density(text, groups), density(title, groups)) if d is not None]
        if found:
            want[i] = round(max(found), 9)
    got = {r["node_id"]: round(r["rank"], 9) for r in ft.search(ft.postings(df), question).collect()}
    assert got == want


def test_postings_of_every_word(nodes):
    df, rows = nodes
    want = sorted((t, i, f, p) for i, *x in rows for f, text in zip(ft.FIELDS, x, strict=True) for t, p in terms(text))
    assert sorted(map(tuple, ft.postings(df).collect())) == want


def test_parsed_questions():
    [[(yes, o)]] = ft.parsed('"engines of the wings"')
    assert yes and o.terms == (("engin", 0), ("wing", 3))
    assert [[(y, o.terms[0][0]) for y, o in g] for g in ft.parsed("wings -red OR the OR -blue or tank")] == [[(True, "wing"), (False, "red")], [(True, "tank")]]


def test_stored_index_reads_the_asked_terms_alone(spark, nodes, tmp_path):
    df, _ = nodes
    path = f"file://{tmp_path}/postings"
    ft.write_postings(ft.postings(df), path, buckets=16, files=2)
    for q in ("red engines", '"engine of the wing" tank -blue'):
        rows = ft.read_postings(spark, path, ft.asked_terms(q), buckets=16)
        assert sorted(map(tuple, ft.search(rows, q).collect())) == sorted(map(tuple, ft.search(ft.postings(df), q).collect()))
    one = ft.read_postings(spark, path, ["wing"], buckets=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(term,wing)" in plan
    folders = {r["f"] for r in spark.read.parquet(path).where("bucket = bucket").select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1).alias("f")).collect()}
    assert {r["f"] for r in one.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1).alias("f")).collect()} < folders


def test_covers_of_a_frequent_pair(spark):
    """Two terms a thousand times each: as many covers as neighbours of different kind."""
    rows = list(itertools.chain.from_iterable((("x", "n", "content_text", 3 * k + 1), ("y", "n", "content_text", 3 * k + 2)) for k in range(1000)))
    df = spark.createDataFrame(rows, "term string, node_id string, field string, pos int")
    [r] = ft.search(df, "x y").collect()
    assert round(r["rank"], 6) == round(1000 * 0.1 + 999 * 0.1 / 2, 6)


def test_stems_are_worked_out_after_words_are_distinct(spark, sf_dir):
    from statuta.queries.fulltext import word_stems

    plan = word_stems(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nth = lambda name: [k for k, line in enumerate(plan) if name in line]
    assert len(nth("ArrowEvalPython")) == 1 and nth("ArrowEvalPython")[0] < min(nth("Aggregate"))


def test_words_that_may_have_a_stem(spark):
    """No word of any form is left out before stems are worked out."""
    rng, ends = random.Random(2), [s for s, *_ in (*en.STEP2, *en.STEP3, *en.STEP4)] + "ative ed edly ing ingly eed s ies ied sses y e ll".split() + [""]
    words = ["".join(rng.choice("aeiouybtlrsngc") for _ in range(rng.randint(1, 5))) + rng.choice(ends) + rng.choice(ends) for _ in range(3000)] + [*en.WHOLE, *en.ALONE]
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(en.stem(w), []).append(w)
    some = sorted(by)[::7] + sorted(set(en.WHOLE.values()))
    df = spark.createDataFrame([(w,) for t in some for w in by[t]], "w string")
    assert df.where(~en.may_be(F.col("w"), some)).count() == 0
    for t in some[::90] + ["die", "idl"]:
        assert spark.createDataFrame([(w,) for w in by[t]], "w string").where(~en.may_be(F.col("w"), [t])).count() == 0


def test_asked_terms_alone_are_made_postings(nodes):
    df, _ = nodes
    only = ["engin", "25", "wing"]
    assert sorted(map(tuple, ft.postings(df, only=only).collect())) == sorted(tuple(r) for r in ft.postings(df).collect() if r["term"] in only)


def test_stored_lists_hold_a_term_once_a_batch(spark, nodes, tmp_path, monkeypatch):
    """Rows of the index are as many as terms and fields of a task's texts, not as occurrences; nothing is grouped for it."""
    df, _ = nodes
    lists = ft.listed(df.coalesce(1))
    assert "Aggregate" not in lists._jdf.queryExecution().optimizedPlan().toString()
    got = lists.collect()
    assert len({(r["term"], r["field"]) for r in got}) == len(got)
    path = f"file://{tmp_path}/lists"
    ft.write_postings(ft.listed(df), path, buckets=8, files=2)
    every = sorted({r["term"] for r in got})
    assert sorted(map(tuple, ft.read_postings(spark, path, every, buckets=8).collect())) == sorted(map(tuple, ft.postings(df).collect()))
    monkeypatch.setattr(ft, "BLOCK_WORDS", 50)  # in this process alone
    batch = df.limit(40).select("node_id", F.lit("x").alias("field"), en.words_of(F.col("content_text")).alias("words")).toArrow().combine_chunks().to_batches()[0]
    blocks = list(ft._lists([batch]))
    assert len(blocks) > 1 and sorted((t["term"], h["node_id"], p) for b in blocks for t in b.to_pylist() for h in t["held"] for p in h["positions"]) == sorted((t, r["node_id"], p) for r in batch.to_pylist() for t, p in terms(" ".join(r["words"])))


def test_alternatives_read_the_postings_once(nodes):
    df, _ = nodes
    plan = ft.search(ft.postings(df), 'tank or "red engine" -wing or blue zzz')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
