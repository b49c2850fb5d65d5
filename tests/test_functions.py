"""Scalar functions and UDFs against worked outcomes and Python models."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import diff
from statuta.functions import references as r
from statuta.functions import text as t
from statuta.functions import udfs


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("title", "kind", "code", "name", "ref"),
    [
        ("21.A.91 Classification", "IR", "21.A.91", "Classification", "21.A.91"),
        ("AMC 1 ACNS.C.PBN.305 X", "AMC", "ACNS.C.PBN.305", "X", "AMC1 ACNS.C.PBN.305"),
        ("GM No 1 to 21.A.101(g)", "GM", "21.A.101(g)", "GM No 1 to 21.A.101(g)", "GM1 21.A.101(g)"),
        ("AMC No. 2 to CS 25.101", "AMC", "25.101", "AMC No. 2 to CS 25.101", "AMC2 25.101"),
        ("Appendix A to GM 21.A.101 Classification", "GM", "Appendix A to GM 21.A.101", "Classification", "Appendix A to GM 21.A.101"),
        ("CS 25J901 Installation", "CS", "25J901", "Installation", "CS 25J901"),
        ("AMC2 25.101 x", "AMC", "25.101", "x", "AMC2 25.101"),
        ("AMC 25.1309 System", "AMC", "25.1309", "System", "AMC 25.1309"),
        ("NOTE foo", "IR", "NOTE", "foo", "NOTE"),
        ("Appendix 1 – Assessment", "AMC", "Appendix 1 – Assessment", "Appendix 1 – Assessment", "Appendix 1 – Assessment"),
        ("General", None, None, "General", None),
    ],
)
def test_titles(spark, title, kind, code, name, ref):
    df = spark.createDataFrame([(title,)], "title string").withColumn("c", r.classified(F.col("title")))
    row = df.select("c.*", r.reference_code(F.col("c.node_type"), F.col("c.code"), F.col("title")).alias("ref")).first()
    assert (row["node_type"], row["code"], row["title"], row["ref"]) == (kind, code, name, ref)


def test_hierarchy_paths(spark):
    df = spark.sql("SELECT array('ANNEX I', '', 'SUBPART A', 'SUBPART A') AS s, 'Doc' AS d UNION ALL SELECT array('SUBPART B'), 'Doc' UNION ALL SELECT array(''), 'Doc' UNION ALL SELECT array('x'), ''")
    assert [x[0] for x in df.select(r.hierarchy_path(F.col("s"), F.col("d"))).collect()] == ["ANNEX I / SUBPART A", "Doc / SUBPART B", "Doc", "x"]


@pytest.mark.parametrize(("ref", "want"), [("AMC1 ORO.GEN.105", "ORO.GEN.105"), ("CS ACNS.B.GEN.1005", "ACNS.B.GEN.1005"), ("Appendix A to GM 21.A.101", "21.A.101"), ("Appendix 4", "§Appendices"), ("AMC 1.ACNS.X", "ACNS.X"), ("CS 25.1302 Explanatory", "25.1302")])
def test_article_code(spark, ref, want):
    assert one(spark, r.article_code(F.col("x0")), x0=ref) == want


def test_dates_and_versions(spark):
    assert str(one(spark, t.latest_date(F.col("x0")), x0="22 February, 2021; 22 February, 2023; tba")) == "2023-02-22"
    assert one(spark, t.latest_version(F.col("x0")), x0="Initial issue; AMENDMENT 3; issue 3; Revision 1") == "Amendment 3"
    assert one(spark, t.latest_version(F.col("x0")), x0=None) is None
    assert one(spark, t.outdated(F.col("x0"), F.col("x1")), x0="Issue 1", x1="ISSUE 1") is False
    assert one(spark, t.outdated(F.col("x0"), F.col("x1")), x0="Issue 1", x1=None) is False


def test_normalised(spark):
    assert one(spark, t.normalised(F.col("x0")), x0=" a \t b \n\n \t\nc ") == "a b\nc"


words = st.text(alphabet="ab c\n.", max_size=400)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_diff_replays(old, new):
    ops = diff.diff_words(old.split(), new.split())
    side = lambda skip: " ".join(o["text"] for o in ops if o["op"] != skip)
    assert side("insert") == " ".join(old.split()) and side("delete") == " ".join(new.split())


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = [0]
        for j, y in enumerate(b):
            left.append(row[j] + 1 if x == y else max(row[j + 1], left[j]))
        row = left
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_diff_is_shortest(a, b):
    runs = diff.script(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    assert [x for op, i, j in runs if op != "insert" for x in a[i:j]] == a
    assert [x for op, i, j in runs if op != "delete" for x in (b if op == "insert" else a)[i:j]] == b
    assert sum(j - i for op, i, j in runs if op == "equal") == longest_common(a, b)
    assert all(p != q for (p, *_), (q, *_) in zip(runs, runs[1:], strict=False))


def test_diff_of_real_texts_is_shortest(spark, sf_dir):
    texts = [r["text"].split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(24).collect()]
    for old, new in zip(texts[::2], texts[1::2], strict=False):
        old, new = old[:400], new[:400]
        ops = diff.diff_words(old, new)
        assert sum(len(o["text"].split()) for o in ops if o["op"] == "equal") == longest_common(old, new)


def test_diff_columns(spark):
    rows = [("a b c", "a c"), (None, "x"), ("x", None), (None, None), ("", " \t"), ("same\u00a0text  here", "same text here"), ("w " * 3000, "w " * 2999 + "v"), ("a b " * 700, "b a " * 700)]
    got = [r.d for r in spark.createDataFrame(rows, "o string, n string").coalesce(1).select(diff.word_diff("o", "n").alias("d")).collect()]
    assert [[(d.op, d.text) for d in g] for g in got[:6]] == [[("equal", "a"), ("delete", "b"), ("equal", "c")], [("insert", "x")], [("delete", "x")], [], [], [("equal", "same text here")]]
    assert [(d.op, len(d.text)) for d in got[6]] == [("equal", 5997), ("delete", 1), ("insert", 1)]
    assert sum(len(d.text.split()) for d in got[7] if d.op == "equal") == 1399
    capped = spark.createDataFrame(rows[:1], "o string, n string").select(diff.word_diff("o", "n", most=2).alias("d")).first().d
    assert len(capped) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc. \n", max_size=900))
def test_splitter(text):
    chunks = udfs.split_text(text, size=60, overlap=10)
    assert all(0 < len(c) <= 70 for c in chunks)
    assert set("".join(text.split())) - set(".") <= set("".join(chunks))
    if 0 < len(text.strip()) and len(text) <= 60:
        assert chunks == [text.strip()]


def test_splitter_overlaps():
    chunks = udfs.split_text("\n\n".join(["x" * 50, "y" * 50, "z" * 50]), size=60, overlap=10)
    assert chunks == ["x" * 50, "x" * 10 + "y" * 50, "y" * 10 + "z" * 50]


def test_markdown_chunks():
    text = "# A\n" + "x" * 30 + "\n## B\ny\n# C\nz"
    got = udfs.chunk_markdown(text, target=20)
    assert "\n".join(c["content"] for c in got) == text
    assert [c["hierarchy"] for c in got] == ["A / B", "C"]  # the headings in force where it is cut


def test_page_blocks():
    s = lambda y, x, text, size=10.0, bold=False: {"y": y, "x": x, "text": text, "size": size, "bold": bold}
    got = udfs.page_blocks([s(10, 50, "b"), s(9, 1, "a"), s(12.5, 1, "c"), s(20, 1, "T", 12.0, True), s(30, 1, "k"), s(30, 200, "7")])
    assert [g["text"] for g in got] == ["a b\nc", "T", "k\t7"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_sdt_html():
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    xml = f"<w:sdt {W}><w:sdtContent>{p('ruletitle', 'R')}{p('none', 'x &lt;')}<w:sdt><w:sdtContent>{p('none', 'in')}</w:sdtContent></w:sdt>{p('heading2', 'H')}{p('ListParagraph', 'i')}</w:sdtContent></w:sdt>"
    assert udfs.content_html(xml) == '<div class="rule"><h3>R</h3><p>x &lt;</p><p>in</p></div><h2>H</h2><ul><li>i</li></ul>'
    assert udfs.content_html("<broken") is None


def test_cut_and_exchanged_words_take_one_pass(monkeypatch):
    from statuta.functions import diff

    def search(*_):
        raise AssertionError("no search is needed")

    monkeypatch.setattr(diff, "_middle", search)
    monkeypatch.setattr(diff, "_traced", search)
    rng = np.random.default_rng(4)
    a = rng.integers(0, 50, 30_000)
    b = np.where(np.arange(len(a)) % 17 == 16, 99, a)
    for x, y, kept in ((a, b, len(a) - len(a) // 17), (b, b[np.arange(len(b)) % 23 != 22], len(a) - len(a) // 23), (b, a, len(a) - len(a) // 17), (a, a[:0], 0), (a, a + 1000, 0)):
        runs = list(diff.matches(x, y))
        assert sum(n for *_, n in runs) == kept and all((x[i : i + n] == y[p : p + n]).all() for i, p, n in runs)
        assert all(i + n <= j and p + n <= q for (i, p, n), (j, q, _) in zip(runs, runs[1:], strict=False))


def test_long_batches_are_worked_on_piece_by_piece(spark, monkeypatch):
    from pyspark.sql import functions as f

    from statuta.functions import columns

    held = []
    real = columns.pa.array
    x = spark.range(1000, numPartitions=1).select(f.when(f.col("id") % 100 != 7, f.concat(f.lit("# h\n"), f.col("id"))).alias("x"))
    got = x.select("x", columns.markdown_chunks("x").alias("c"), columns.recursive_split("x").alias("s")).collect()
    assert all([r["content"] for r in row["c"]] == [row["x"] or ""] and row["s"] == ([row["x"]] if row["x"] else []) for row in got) and len(got) == 1000
    monkeypatch.setattr(columns.F, "arrow_udf", lambda run, _: lambda *_: run)
    monkeypatch.setattr(columns.pa, "array", lambda rows, kind: held.append(len(rows)) or real(rows, kind))
    batch = real(["<a/>"] * 1000)
    assert sum(len(p) for p in columns.sdt_html("x")(iter([batch]))) == 1000 and max(held) == columns.ROWS


def test_pages_of_a_batch_keep_their_spans(spark):
    from statuta.functions.columns import page_blocks

    span = lambda y, x, text: {"y": y, "x": x, "size": 10.0, "bold": False, "text": text}
    pages = [[span(1.0, 9.0, "b"), span(0.5, 1.0, "a")], None, [], [span(0.0, 0.0, "x"), span(0.0, 90.0, "7"), span(9.0, 0.0, None)], [span(None, None, "z")]]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, s array<struct<y:double,x:double,size:double,bold:boolean,text:string>>").coalesce(1)
    got = {r["k"]: [b["text"] for b in r["b"]] for r in df.select("k", page_blocks("s").alias("b")).collect()}
    assert got == {0: ["a b"], 1: [], 2: [], 3: ["x\t7"], 4: ["z"]}
