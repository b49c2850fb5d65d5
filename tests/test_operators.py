"""Operators on small tables, with nulls, ties and repeats."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from statuta.catalog_of_queries import ORACLES
from statuta.operators import admin, catalog, graph, sequences, versions
from statuta.operators.dedup import keep_unseen
from statuta.plans import chunking, harvest
from statuta.schemas import TABLES
from statuta.sinks import tree_lines, write_trees, write_version
from statuta.sources import json_docs, landed


def test_schemas(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_upsert_is_idempotent_and_keeps_created(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, None)], "k int, v string, created int, link string")
    new = spark.createDataFrame([(2, "B", 9, None), (3, "c", 9, "z")], old.schema)
    up = lambda a, b: versions.upsert(a, b, ["k"], keep_old=("created",), fill=("link",))
    once = up(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1, "x"), (2, "B", 1, None), (3, "c", 9, "z")]
    assert sorted(map(tuple, up(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_no_self_edges_and_priority(spark):
    nodes = spark.createDataFrame([("1", "CS", "x"), ("2", "IR", "x"), ("3", "AMC", "y")], "node_id string, node_type string, reference_code string")
    edges = spark.createDataFrame([("y", "x", "R"), ("x", "x", "R"), ("y", "gone", "R")], "source_ref string, target_ref string, relation string")
    assert [tuple(r) for r in graph.resolve(edges, nodes).collect()] == [("3", "2", "R")]


def test_base_article_order(spark):
    nodes = spark.createDataFrame([("1", "CS", "CS 25.101"), ("2", "CS", "CS 25.102"), ("3", "AMC", "AMC2 25.101(a)(1)"), ("4", "GM", "Appendix A to GM 25.102(b)"), ("5", "AMC", "AMC 9.9")], "node_id string, node_type string, reference_code string")
    got = {(r["source_node_id"], r["target_ref"], r["relation"]) for r in graph.base_article_edges(nodes).collect()}
    assert got == {("3", "CS 25.101", "ACCEPTABLE_MEANS"), ("4", "CS 25.102", "GUIDANCE_FOR")}


def test_members_and_siblings(spark):
    rows = [("1", "GM", "GM1 25.1", "a"), ("2", "CS", "CS 25.1", "a"), ("3", "AMC", "AMC 25.1", "a"), ("4", "CS", "CS 25.2", "b"), ("5", "CS", "CS 25.3", None), ("6", "CS", "CS 25.1", "a")]
    m = graph.memberships(spark.createDataFrame(rows, "node_id string, node_type string, reference_code string, article string"), ["article"])
    assert {(r["node_id"], r["place"], r["members"]) for r in m.collect()} == {("2", 1, 4), ("6", 2, 4), ("3", 3, 4), ("1", 4, 4), ("4", 1, 1), ("5", 1, 1)}
    assert {(r["node_id"], r["sibling_id"], r["place"]) for r in graph.siblings_of(m, ["article"], ["3", "4", "none"]).collect()} == {("3", "2", 1), ("3", "6", 2), ("3", "1", 4)}


def test_shown_paragraphs(spark):
    from statuta.operators import blocks

    lines = [("(a) one", "indent-1"), ("(iv) two", "indent-3"), ("(2) three", "indent-2"), ("b. four", "indent-1"), ("c) five", "indent-1"), ("NOTE: six", "note"), ("1.1 seven", "plain"), ("3 General aims", "heading"), ("a\tb", "table")]
    df = spark.createDataFrame([("d", k, t) for k, (t, _) in enumerate(lines)] + [("d", 99, None)], "doc string, pos int, text string")
    got = blocks.paragraphs(df, "doc", "pos", "text", rows=2).orderBy("element").collect()
    assert [(r["body"], r["shown"]) for r in got] == lines and got[-1]["cells"] == [["a", "b"]]


def test_ancestors(spark):
    s = spark.createDataFrame([("d", 1, "4", "Four"), ("d", 2, "4.1.2", "Deep"), ("d", 3, "4.1", "Late"), ("d", 4, "4.1.3", "x"), ("d", 5, "5.1", "y")], "doc string, pos int, code string, title string")
    got = {r["pos"]: r["ancestors"] for r in sequences.ancestor_paths(s, "doc", "pos", "code", "title").collect()}
    assert got == {1: "", 2: "4 Four / 4.1", 3: "4 Four", 4: "4 Four / 4.1 Late", 5: "5"}


def test_fold_keeps_unseen(spark):
    df = spark.sql("SELECT transform(array('1a', '1b', '2b', '3b', '4a'), x -> named_struct('i', int(left(x, 1)), 'r', right(x, 1))) AS h")
    got = df.select(keep_unseen(F.col("h"), lambda x: x["i"], lambda x: x["r"]).alias("k")).first()[0]
    assert [tuple(x) for x in got] == [(1, "a"), (2, "b")]


PATTERNS = ["%x%", "%Amendment 1%", "easy%rules", "%ru_es%", "%50\\\\%%", "%", "none", None, "", "a_c", "Éa%", "%a\\_b%", "___", "%ules%ules%"]
TITLES = ["x", "xy", None, "", "Easy Rules", "easy access RULES", "Amendment 12", "rubles", "rules", "50% off", "50 off", "abc", "ÉAB", "a_b", "axb", "rules and rules"]


def like(pattern, text):
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(out.lower(), text.lower(), re.S) is not None


@pytest.mark.parametrize("rows_a_block", [10_000, 1])
def test_patterns_against_a_plain_model(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(catalog, "PATTERN_ROWS", rows_a_block)
    e = spark.createDataFrame([(f"e{k}", p) for k, p in enumerate(PATTERNS)], "id string, title_pat string")
    d = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(TITLES)], "doc_id string, title string")
    got = sorted((r["id"], r["doc_id"]) for r in catalog.pattern_join(e, d).collect())
    assert got == sorted((f"e{i}", f"d{j}") for i, p in enumerate(PATTERNS) for j, t in enumerate(TITLES) if p is not None and t is not None and like(p, t))


def test_patterns_with_an_anchor_need_no_loop(spark):
    e = spark.createDataFrame([("a", "%rules%"), ("b", "easy%")], "id string, title_pat string")
    d = spark.createDataFrame([("d", "Easy Rules")], "doc_id string, title string")
    hit = catalog.pattern_join(e, d)
    assert "NestedLoop" not in hit._jdf.queryExecution().executedPlan().toString() and hit.count() == 2


def test_harvest(spark):
    ddl = "node_type string, reference_code string, source_doc_id string, content_text string, content_hash string"
    stored = spark.createDataFrame([("IR", "1", "d", "a b", "h1"), ("IR", "2", "d", "x", "h2"), ("IR", "9", "other", "k", "h9")], ddl)
    batch = spark.createDataFrame([("IR", "1", "d", "a c", "h3", 0), ("IR", "3", "d", "again", "h5", 2), ("IR", "3", "d", "n", "h4", 1)], ddl + ", pos int").repartition(3)
    got = harvest.ingest(stored, batch, "v2")
    assert {r["reference_code"] for r in got["nodes"].collect()} == {"1", "3", "9"}
    assert got["run"].first().asDict() == {"nodes_added": 1, "nodes_modified": 1, "nodes_unchanged": 0, "nodes_deleted": 1, "nodes_total": 3}
    assert {(r["change_type"], r["content_text"]) for r in got["versions"].collect()} == {("modified", "a c"), ("added", "n"), ("deleted", "x")}
    diff = got["versions"].where("change_type = 'modified'").first()["diff_prev"]
    assert [(d["op"], d["text"]) for d in diff] == [("equal", "a"), ("delete", "b"), ("insert", "c")]


NODE = "node_id string, node_type string, reference_code string, title string, hierarchy_path string, content_text string"


def test_chunks(spark):
    n = spark.createDataFrame([("1", "IR", "r", "t", "A / B", "short"), ("2", "IR", "q", None, "A", "x " * 1500), ("3", "IR", "e", "t", "A", ""), ("4", "GROUP", "g", "t", "A", "z")], NODE)
    got = {r["chunk_id"]: r["document"] for r in chunking.chunks(n).collect()}
    assert got["1"] == "A > A / B > r — t\n\nshort" and {k for k in got if k[0] == "2"} == {"2", "2__c1", "2__c2"} and not {k for k in got if k[0] in "34"}
    fresh = spark.createDataFrame([("2", "2")], "chunk_id string, parent_node_id string")
    assert {r["chunk_id"] for r in chunking.surplus(chunking.chunks(n), fresh).collect()} == {"2__c1", "2__c2"}


def test_only_changed_nodes_are_chunked_and_embedded(spark):
    long = "word " * 900
    old = spark.createDataFrame([(str(k), "IR", f"r{k}", "t", "A", long if k < 3 else f"text {k}") for k in range(12)], NODE)
    new = [(str(k), "IR", f"r{k}", "t", "A" if k != 5 else "B", "now short" if k == 0 else long if k < 3 else "" if k == 7 else f"text {k}") for k in range(11)] + [("new", "IR", "n", None, "A", "more")]
    stored = chunking.chunks(old).cache()
    fresh, removed = chunking.rechunked(spark.createDataFrame(new, NODE), stored)
    assert {r["parent_node_id"] for r in fresh.collect()} == {"0", "5", "new"}
    parts = {r["chunk_id"] for r in stored.where("parent_node_id = '0'").collect()}
    assert {r["chunk_id"] for r in removed.collect()} == (parts - {"0"}) | {"7", "11"}
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if any("more" in t for t in texts):
            raise RuntimeError("too long")
        return chunking.hashed_embedding(texts)

    got = chunking.embedded(fresh.coalesce(1), embed).collect()
    assert {r["parent_node_id"] for r in got} == {"0", "5"} and all(len(r["embedding"]) == 64 for r in got)
    assert calls.value == 6  # three in a request that fails, then one by one
    stored.unpersist()


def test_fingerprints_in_blocks_and_sizes(spark, tmp_path):
    import hashlib

    body = {"a b.bin": bytes(range(256)) * 9000, "empty": b"", "sub/c": b"x" * (1 << 20)}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in body.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/in/")[-1].replace("%20", " "): (r["length"], r["content_hash"]) for r in landed.fingerprints(spark, str(tmp_path / "in"), block=100_000).collect()}
    assert got == {k: (len(d), hashlib.md5(d).hexdigest()) for k, d in body.items() if d}
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    [r] = landed.table_sizes({"t": spark.read.parquet(str(tmp_path / "t"))}).collect()
    assert (r["files"], r["bytes"]) == (3, sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")))


def test_archives_and_packages(spark, tmp_path):
    w, er = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://www.easa.europa.eu/erules-export"
    sdt = lambda i, t: f'<w:sdt><w:sdtPr><w:id w:val="{i}"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:sdtContent></w:sdt>'
    xml = f'<p xmlns:w="{w}" xmlns:er="{er}"><er:heading title="ANNEX I"/><er:topic sdt-id="1" source-title="21.A.1 X"/><er:topic sdt-id="2" source-title="none"/>{sdt(1, "first")}{sdt(1, "last")}</p>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.xml", xml)
        z.writestr("b.txt", "x" * 9999)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.zip").write_bytes(buffer.getvalue())
    (tmp_path / "in" / "p.pdf").write_bytes(b"%PDF-1.7 x")
    files = landed.files(spark, str(tmp_path / "in"))
    assert {r["kind"] for r in files.collect()} == {"zip", "pdf"}
    members = landed.zip_members(files)
    assert [r["member"] for r in landed.chosen_member(members).collect()] == ["a.xml"]
    rows = landed.package_rows(members.where("member = 'a.xml'").select("path", F.col("body").alias("content")))
    topics = landed.topics_with_text(rows)
    assert [(r["title"], r["content_text"]) for r in topics.collect()] == [("21.A.1 X", "last")]
    assert '"21.A.1 X"' in tree_lines(topics.withColumns({"heading": F.lit("h"), "pos": F.lit(0)})).first()["line"]


def test_packages_are_pulled(spark, tmp_path):
    """Nested controls, tables, broken packages; archives by member, in several tasks."""
    w, er = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://www.easa.europa.eu/erules-export"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>.</w:t></w:r></w:p>"
    sdt = lambda i, alias, body: f'<w:sdt><w:sdtPr><w:alias w:val="{alias}"/><w:id w:val="{i}"/></w:sdtPr><w:sdtContent>{body}</w:sdtContent></w:sdt>'
    body = p("front") + sdt(1, "topic", p("a") + sdt(2, "part", p("b")) + "<w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>" + p(" ")) + sdt(3, "topic", "")
    xml = f'<pkg xmlns:w="{w}" xmlns:er="{er}"><er:heading title=" A "/><er:topic sdt-id="1" source-title="T1" ERulesId="e1"/>{body}</pkg>'
    df = spark.createDataFrame([("x", bytearray(xml.encode())), ("broken", bytearray(xml.encode()[:-20])), ("none", bytearray(b"")), ("null", None)], "path string, content binary")
    rows = landed.package_rows(df)
    said = {(r["path"], r["sdt_id"]): " ".join(r["text"].split()) for r in rows.where("kind = 'sdt'").collect()}
    assert said == {(d, i): t for d in ("x", "broken") for i, t in (("1", "a . b . cell . ."), ("2", "b ."))} | {("x", "3"): ""}
    order = [r["kind"] + (r["sdt_id"] or "") for r in rows.where("path = 'x'").orderBy("pos").collect()]
    assert order == ["heading", "topic1", "sdt1", "sdt2", "sdt3"]
    got = landed.pruned(rows.where("path = 'x'")).collect()
    assert [(r["sdt_id"], r["para"], r["text"], r["erules_id"]) for r in got] == [("1", 0, "a.", "e1"), ("1", 1, ".", "e1")]
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(8):
            z.writestr(f"m{k}.xml", xml.replace("T1", f"T{k}"))
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    members = landed.archive_members(spark, str(tmp_path / "in"))
    assert {(r["member"], r["size"]) for r in members.collect()} == {(f"m{k}.xml", len(xml)) for k in range(8)}
    read = landed.archive_rows(members, tasks=4).withColumn("task", F.spark_partition_id())
    assert {r["title"] for r in read.where("kind = 'topic'").collect()} == {f"T{k}" for k in range(8)}
    assert read.select("task").distinct().count() > 1


def test_trees_are_json(spark, tmp_path):
    """Lines of a document, put together, parse to its topics under their headings."""
    import json

    rows = [("d", h, p, f't"{p}', None if p == 4 else f"a\nb\t\\ \u00e9 \x01 {p}") for p, h in enumerate(["B", "A", "B", None, "A", None, "C"])] + [("e", "A", 9, None, "x"), (None, "A", 1, "t", "y")]
    df = spark.createDataFrame(rows, "path string, heading string, pos int, title string, content_text string").repartition(4)
    write_trees(df, str(tmp_path / "out"), files=3)
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    decoder, at, docs = json.JSONDecoder(), 0, {}
    while at < len(text.rstrip()):
        doc, end = decoder.raw_decode(text, at)
        docs[doc["path"]] = [(s["heading"], [tuple(t.values()) for t in s["topics"]]) for s in doc["toc"]]
        at = end + (len(text[end:]) - len(text[end:].lstrip()))
    d = lambda p: (p, f't"{p}', None if p == 4 else f"a\nb\t\\ \u00e9 \x01 {p}")
    assert docs == {"d": [("B", [d(0), d(2)]), ("A", [d(1), d(4)]), (None, [d(3), d(5)]), ("C", [d(6)])], "e": [("A", [(9, None, "x")])], None: [("A", [(1, "t", "y")])]}


def test_json_round_trip(spark, tmp_path):
    rows = [("IR", f"{k}", None if k == 2 else "t", "h", f"text {k}", d, -k, "html", "v1") for d in ("d", "e") for k in range(4)]
    n = spark.createDataFrame(rows, "node_type string, reference_code string, title string, hierarchy_path string, content_text string, source_doc_id string, pos int, content_html string, version_label string").repartition(3)
    rel = spark.createDataFrame([("d", "2", "1", "REQUIRES", 0.5), ("d", "1", "2", "SEE_ALSO", None)], "source_doc_id string, source_ref string, target_ref string, relation string, confidence double")
    json_docs.write(n, str(tmp_path / "j"), rel)
    docs = spark.read.schema(json_docs.SCHEMA).json(str(tmp_path / "j"))
    back = json_docs.node_rows(docs).orderBy("doc_title", "pos").collect()
    assert [(r["doc_title"], r["reference_code"], r["title"]) for r in back] == [(d, f"{k}", None if k == 2 else "t") for d in ("d", "e") for k in (3, 2, 1, 0)]
    assert [(r["source_ref"], r["target_ref"], r["relation"], r["confidence"]) for r in json_docs.relation_rows(docs).collect()] == [("1", "2", "SEE_ALSO", 0.8), ("2", "1", "REQUIRES", 0.5)]
    assert {(r["title"], r["version"], len(r["relations"])) for r in docs.collect()} == {("d", "v1", 2), ("e", "v1", 0)}
    json_docs.write(n.drop("pos", "content_html", "version_label"), str(tmp_path / "k"))
    assert [r["reference_code"] for r in json_docs.node_rows(spark.read.schema(json_docs.SCHEMA).json(str(tmp_path / "k")).where("title = 'd'")).orderBy("pos").collect()] == ["0", "1", "2", "3"]
    assert write_version(n, str(tmp_path / "t"), 3).endswith("v=00000003")


def test_headings_of_pages(spark):
    from statuta.functions import headings as h

    rows = [("AMC to Appendix S, S25.30(a) Seats\nmore", "AMC to Appendix S, S25.30(a) Seats", "more"), ("CS 25.581(b)(1) Lightning", "CS 25.581(b)(1)", "Lightning"), ("GM 25-1", "GM 25-1", "GM 25-1"), ("Plain words\nnext", "Plain words", "next")]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", h.heading_parts(F.col("t")).alias("p")).collect()
    assert {(r.t, r.p.reference_code, r.p.title) for r in got} == set(rows)
    lines = [("4.1 Aim", True, "4.1"), ("4.1 Aim", False, None), ("199 ft", True, None), ("51", True, None), ("50", True, "50"), ("3.2 KM", True, None), ("7 Aim ..... 3", True, None), ("9" * 50, True, None), (None, True, None)]
    got = spark.createDataFrame(lines, "t string, b boolean, n string").select("n", h.numbered_heading(F.col("t"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]
    noise = [("Page 3 of 9", True), ("BOOK 1", True), ("© 2020 X", True), ("Scope ..... 4", True), ("The page 3 of 9", False), ("CS 25.1 Scope", False)]
    got = spark.createDataFrame(noise, "t string, n boolean").select("n", h.is_noise(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_catalogue_refuses(spark):
    import pytest

    old = spark.createDataFrame([("a", "A", True, 4)], "id string, name string, is_active boolean, sort_order int")
    with pytest.raises(ValueError, match="missing"):
        admin.created(old, {"id": "b"}, ("id", "name"))
    with pytest.raises(ValueError, match="exists"):
        admin.created(old, {"id": "a", "name": "B"}, ("id", "name"))
    assert [tuple(r) for r in admin.created(old.limit(0), {"id": "b", "name": "B"}, ("id", "name")).collect()] == [("b", "B", True, 1)]


def test_scores_of_a_model(spark):
    from statuta.functions import headings as h

    rows = [('```json\n{"1": 9}\n```', 9), ('{"1": 8.9}', 8), ('{"2": 3}', 5), ('{"1": null}', 5), ('{"1": "many", "2": 3}', 5), ("", 5), (None, 5), ("[1]", 5)]
    got = spark.createDataFrame(rows, "a string, n int").select("n", h.score_of(h.model_scores(F.col("a")), F.lit(1)).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_equal_patterns_and_texts_meet_once(spark):
    e = spark.createDataFrame([(f"e{k}", "%a%" if k % 2 else "%rules%") for k in range(40)] + [("none", None), ("e0", "a")], "id string, title_pat string")
    d = spark.createDataFrame([(f"d{k}", "Easy Rules", k) for k in range(50)] + [("x", None, 1), ("y", "a", 60)], "doc_id string, title string, n long")
    assert {tuple(r) for r in catalog.named_texts(e, d).collect()} == {("%rules%", "Easy Rules"), ("%a%", "a"), ("a", "a"), ("%a%", "Easy Rules")}
    assert catalog.pattern_join(e, d).count() == 40 * 50 + 20 + 1
    best = {r["id"]: (r["doc_id"], r["node_count"]) for r in catalog.best_documents(e, d).collect()}
    assert best == {f"e{k}": ("y", 60) if k % 2 or not k else ("d49", 49) for k in range(40)}


def test_siblings_are_all_pairs(spark, sf_dir):
    from statuta.queries import graph as queries

    pairs = {tuple(r) for r in queries.siblings(spark, sf_dir).select("node_id", "sibling_id").collect()}
    places = queries.sibling_places(spark, sf_dir).collect()
    assert pairs and len(pairs) == sum(r["members"] - 1 for r in places) and pairs == {(b, a) for a, b in pairs}


def test_linked_deals_sources_evenly(spark, monkeypatch):
    n = spark.createDataFrame([(f"s{k}", "a") for k in range(30)] + [(f"t{k}", "b") for k in range(20)] + [("z", "c"), ("o", None)], "node_id string, reference_code string")
    w = spark.createDataFrame([("a", "b", "R"), ("a", "gone", "R"), (None, "b", "R"), ("c", "c", "S")], "source_ref string, target_ref string, relation string")
    want = sorted([(f"s{i}", f"t{j}", "R") for i in range(30) for j in range(20)] + [("z", "z", "S")])
    few = graph.linked(w, n)
    assert sorted(map(tuple, few.collect())) == want
    assert "REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, graph.linked(w, n).collect())) == want


def test_rechunk_of_texts_without_chunks(spark, tmp_path):
    from statuta.queries import chunks as queries
    from tests import compare

    texts = (None, "", "   ", "\n\n", ". " * 700, "a", "x" * 1300, " " * 1300, "word " * 400, "\u001f", " \n a")
    rows = [(k, t, None if k % 11 == 4 else f"src{k % 4}") for k, t in enumerate(t for t in texts for _ in range(70))]
    rows += [(k, text, f"src{k % 3}") for k in range(0, 700, 9) for text in ("another", "")]  # ids that repeat
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = compare.duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compare.assert_same(spark, c, str(tmp_path), queries.rechunk, ORACLES["rechunk"])


def test_chunks_of_a_node_that_lost_them_go(spark):
    old = spark.createDataFrame([("1", "IR", "r", "t", "A", "word " * 900), ("2", "IR", "q", "t", "A", " "), ("3", "IR", "p", "t", "A", "same")], NODE)
    new = spark.createDataFrame([("1", "IR", "r", "t", "A", "\n"), ("2", "IR", "q", "t", "A", " "), ("3", "IR", "p", "t", "A", "same")], NODE)
    stored = chunking.chunks(old)
    fresh, removed = chunking.rechunked(new, stored)
    assert not fresh.count() and {r["chunk_id"] for r in removed.collect()} == {r["chunk_id"] for r in stored.collect()} - {"3"}
    held = chunking.embeddable(old).select("node_id", "source_hash")
    assert [r["node_id"] for r in chunking.changed_nodes(new, stored, held).collect()] == ["1"]


def test_linked_sources_are_shuffled_once_and_targets_come_in_blocks(spark, monkeypatch):
    n = spark.createDataFrame([(f"s{i}", "a") for i in range(40)] + [(f"t{j}", f"b{j % 3}") for j in range(90)] + [(None, "b0"), ("t1", "b1"), ("u", None)], "node_id string, reference_code string")
    w = spark.createDataFrame([("a", f"b{k}", r) for k in range(3) for r in ("R", "S", None)] + [("a", "b1", "R"), ("a", "gone", "R"), ("gone", "b1", "R"), (None, "b1", "R")], "source_ref string, target_ref string, relation string")
    targets = {k: [f"t{j}" for j in range(k, 90, 3)] + [[None], ["t1"], []][k] for k in range(3)}
    want = sorted(repr((f"s{i}", t, r)) for i in range(40) for k in range(3) for t in targets[k] for r in ["R", "S", None] + ["R"] * (k == 1))
    monkeypatch.setattr(graph, "BLOCK", 7)
    got = graph.linked(w, n)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(plan) == 2 and "Sort [target_ref" in plan[0] and "Inner" not in plan[1].split("LogicalRDD")[0]
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    assert sorted(repr(tuple(r)) for r in graph.linked(w, n).collect()) == want
