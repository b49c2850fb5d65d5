"""Scalar parsing and order-sensitive parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references as r
from ..functions import text as t
from ..operators import sequences as s
from ..operators.topics import typed_topics
from ..sources import views as v
from . import query


@query(f"""WITH {v.NODE_ROWS} SELECT node_id, split_part(hierarchy_path, ' / ', 1) AS root, split_part(hierarchy_path, ' / ', 2) AS subpart, split_part(hierarchy_path, ' / ', 3) AS section,
NULLIF(split_part(hierarchy_path, ' / ', 4), '') AS rest FROM node_rows""")
def hierarchy_split(spark, sf_dir):
    """F1."""
    p = lambda k: F.split_part("hierarchy_path", F.lit(" / "), F.lit(k))
    return v.node_rows(spark, sf_dir).select("node_id", p(1).alias("root"), p(2).alias("subpart"), p(3).alias("section"), F.nullif(p(4), F.lit("")).alias("rest"))


def _amended(spark, sf_dir):
    """Order priorities and dates as lists of amendments and dates, as topics carry them."""
    o = v.read(spark, sf_dir, "orders")
    word = F.element_at(F.array(F.lit("AMENDMENT"), F.lit("issue"), F.lit("Revision"), F.lit("Initial issue")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", F.concat_ws("; ", F.concat(word, F.lit(" "), F.col("o_orderkey") % 9), F.lit("Initial issue"), F.concat(F.lit("Amendment "), F.col("o_custkey") % 7)).alias("amended_by"), F.concat(F.date_format("o_orderdate", "d MMMM, yyyy"), F.lit("; tba; 1 March, 1996")).alias("dates"))


_AMENDED = """a AS (SELECT o_orderkey, (['AMENDMENT', 'issue', 'Revision', 'Initial issue'])[(o_custkey % 4 + 1)::INTEGER] AS w, o_orderkey % 9 AS n, o_custkey % 7 AS m, o_orderdate FROM orders)"""


@query(f"""WITH {_AMENDED} SELECT o_orderkey, CASE WHEN w <> 'Initial issue' THEN upper(substring(w, 1, 1)) || lower(substring(w, 2)) || ' ' || n WHEN TRUE THEN 'Issue ' || n END AS label,
CASE WHEN n >= m THEN (CASE WHEN w = 'Initial issue' THEN 'Issue' ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END) || ' ' || n ELSE 'Amendment ' || m END AS latest FROM a""")
def latest_version(spark, sf_dir):
    """A8, F12, F40."""
    return _amended(spark, sf_dir).select("o_orderkey", t.version_label(F.col("amended_by")).alias("label"), t.latest_version(F.col("amended_by")).alias("latest"))


@query(f"WITH {_AMENDED} SELECT o_orderkey, GREATEST(o_orderdate::DATE, DATE '1996-03-01') AS latest FROM a")
def latest_date(spark, sf_dir):
    """A9, F37."""
    return _amended(spark, sf_dir).select("o_orderkey", t.latest_date(F.col("dates")).alias("latest"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'x amendment 12 issue 3' WHEN 1 THEN 'ISSUE 4' WHEN 2 THEN 'the initial issue' WHEN 3 THEN 'revision 7' ELSE html END AS html FROM pages),
l AS (SELECT page_id, COALESCE(NULLIF(regexp_extract(substring(html, 1, 32768), '(?i)(amendment\\s+\\d+)', 1), ''), NULLIF(regexp_extract(substring(html, 1, 32768), '(?i)(issue\\s+\\d+)', 1), ''),
  NULLIF(regexp_extract(substring(html, 1, 32768), '(?i)(revision\\s+\\d+)', 1), ''), NULLIF(regexp_extract(substring(html, 1, 32768), '(?i)(initial\\s+issue)', 1), '')) AS hit FROM p)
SELECT page_id, upper(substring(hit, 1, 1)) || substring(hit, 2) AS version_label FROM l""".replace("\\\\", "\\"))
def version_label(spark, sf_dir):
    """The version probe of a page's head (32 KB by its definition)."""
    k = F.col("page_id") % 5
    html = F.when(k == 0, "x amendment 12 issue 3").when(k == 1, "ISSUE 4").when(k == 2, "the initial issue").when(k == 3, "revision 7").otherwise(F.col("html"))
    return v.read(spark, sf_dir, "pages").select("page_id", t.probed_version(html).alias("version_label"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'CS 25J' || p_partkey || '(a)(1)' WHEN 1 THEN 'AMC2 25.' || p_partkey WHEN 2 THEN 'Appendix A to GM 21.A.' || p_partkey || '(b)' WHEN 3 THEN 'Appendix 1' WHEN 4 THEN 'AMC 1.ACNS.B.' || p_partkey
  WHEN 5 THEN '25.' || p_partkey || ' Explanatory material' ELSE 'GM ORO.GEN.' || p_partkey || ' (a);(b)' END AS ref FROM part)
SELECT p_partkey, ref, CASE p_partkey % 7 WHEN 0 THEN '25J' || p_partkey WHEN 1 THEN '25.' || p_partkey WHEN 2 THEN '21.A.' || p_partkey WHEN 3 THEN '§Appendices' WHEN 4 THEN 'ACNS.B.' || p_partkey WHEN 5 THEN '25.' || p_partkey ELSE 'ORO.GEN.' || p_partkey END AS article,
  trim(regexp_replace(ref, '\\s*\\([^)]*\\)\\s*$', '')) AS base_ref FROM c""".replace("\\\\", "\\"))
def article_code(spark, sf_dir):
    """F30, F27."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 7
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    ref = F.when(k == 0, c("CS 25J", n, "(a)(1)")).when(k == 1, c("AMC2 25.", n)).when(k == 2, c("Appendix A to GM 21.A.", n, "(b)")).when(k == 3, "Appendix 1").when(k == 4, c("AMC 1.ACNS.B.", n)).when(k == 5, c("25.", n, " Explanatory material")).otherwise(c("GM ORO.GEN.", n, " (a);(b)"))
    return v.read(spark, sf_dir, "part").select("p_partkey", ref.alias("ref")).withColumns({"article": r.article_code(F.col("ref")), "base_ref": r.base_ref(F.col("ref"))})


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'CS-25' WHEN 1 THEN 'Part-ADR.OPS' WHEN 2 THEN 'Part 21' WHEN 3 THEN 'Part 21 Light' ELSE s_name END AS label FROM supplier""")
def doc_label(spark, sf_dir):
    """F31."""
    k = F.col("s_suppkey") % 5
    root = F.when(k == 0, "Easy Rules for Aeroplanes (cs-25)").when(k == 1, "ANNEX IV (Part-ADR.OPS)").when(k == 2, "Annex I").when(k == 3, " annex ib").otherwise(F.col("s_name"))
    return v.read(spark, sf_dir, "supplier").select("s_suppkey", r.doc_label(root).alias("label"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10)) AS body FROM documents""")
def text_normalise(spark, sf_dir):
    """F5."""
    return v.read(spark, sf_dir, "documents").select("doc_id", t.normalised(F.col("text")).alias("body"))


@query("SELECT doc_id, md5(text) AS md5, substring(sha256(text), 1, 16) AS short_sha FROM documents")
def content_hash(spark, sf_dir):
    """F4."""
    return v.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 16).alias("short_sha"))


@query("SELECT event_id, COALESCE(lower(event_type) <> lower(CASE WHEN event_id % 3 = 0 THEN 'CLICK' WHEN event_id % 3 = 1 THEN 'view' END), FALSE) AS outdated FROM events")
def outdated(spark, sf_dir):
    """F38."""
    remote = F.when(F.col("event_id") % 3 == 0, "CLICK").when(F.col("event_id") % 3 == 1, "view")
    return v.read(spark, sf_dir, "events").select("event_id", t.outdated(F.col("event_type"), remote).alias("outdated"))


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, doc_id::VARCHAR AS n, replace(substring(text, 1, 30), chr(10), ' ') AS w FROM documents),
f AS (SELECT *, regexp_extract(w, '^\s*({r.CODE})(?:\s|$)', 1) AS own FROM d),
t AS (SELECT *, CASE k WHEN 0 THEN '21.A.' || n || ' ' || w WHEN 1 THEN 'AMC 1 ACNS.C.' || n || ' ' || w WHEN 2 THEN 'GM No 1 to 21.A.' || n || '(g)' WHEN 3 THEN 'Appendix A to GM 21.A.' || n || ' ' || w WHEN 4 THEN 'CS 25J' || n || ' ' || w WHEN 5 THEN 'AMC2 25.' || n || ' x'
  WHEN 6 THEN 'Appendix 1 – ' || w ELSE w END AS title FROM f)
SELECT doc_id, title, CASE k WHEN 0 THEN 'IR' WHEN 1 THEN 'AMC' WHEN 2 THEN 'GM' WHEN 3 THEN 'GM' WHEN 4 THEN 'CS' WHEN 5 THEN 'AMC' WHEN 6 THEN 'AMC' ELSE CASE WHEN own <> '' THEN 'IR' END END AS node_type,
CASE k WHEN 0 THEN '21.A.' || n WHEN 1 THEN 'ACNS.C.' || n WHEN 2 THEN '21.A.' || n || '(g)' WHEN 3 THEN 'Appendix A to GM 21.A.' || n WHEN 4 THEN '25J' || n WHEN 5 THEN '25.' || n WHEN 6 THEN trim(title) ELSE NULLIF(own, '') END AS code,
CASE k WHEN 0 THEN '21.A.' || n WHEN 1 THEN 'AMC1 ACNS.C.' || n WHEN 2 THEN 'GM1 21.A.' || n || '(g)' WHEN 3 THEN 'Appendix A to GM 21.A.' || n WHEN 4 THEN 'CS 25J' || n WHEN 5 THEN 'AMC2 25.' || n WHEN 6 THEN trim(title) ELSE NULLIF(own, '') END AS reference_code FROM t""")
def classify_titles(spark, sf_dir):
    """type, code and reference of titles made from documents; tests hold the worked outcomes."""
    d = v.read(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 8)
    n = F.col("doc_id").cast("string")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    w = F.translate(F.substring("text", 1, 30), "\n", " ")
    title = F.when(F.col("k") == 0, c("21.A.", n, " ", w)).when(F.col("k") == 1, c("AMC 1 ACNS.C.", n, " ", w)).when(F.col("k") == 2, c("GM No 1 to 21.A.", n, "(g)")).when(F.col("k") == 3, c("Appendix A to GM 21.A.", n, " ", w)).when(F.col("k") == 4, c("CS 25J", n, " ", w)).when(F.col("k") == 5, c("AMC2 25.", n, " x")).when(F.col("k") == 6, c("Appendix 1 – ", w)).otherwise(w)
    d = d.select("doc_id", title.alias("title")).withColumn("c", r.classified(F.col("title")))
    return d.select("doc_id", "title", F.col("c.node_type").alias("node_type"), F.col("c.code").alias("code"), r.reference_code(F.col("c.node_type"), F.col("c.code"), F.col("title")).alias("reference_code"))


@query("""WITH t AS (SELECT source AS doc, doc_id AS pos, upper(lang) AS stack, doc_id % 6 AS k, doc_id % 11 <> 0 AS has_text, (doc_id // 6) % 3 AS said, '25.' || doc_id AS code FROM documents),
p AS (SELECT *, LAST_VALUE(CASE k WHEN 0 THEN 'CS ' || code WHEN 1 THEN 'AMC ' || code WHEN 2 THEN 'CS ' || code END IGNORE NULLS) OVER (PARTITION BY doc, stack ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM t)
SELECT doc, pos, CASE WHEN k IN (0, 5) THEN 'CS' WHEN k IN (1, 3) THEN 'AMC' ELSE (['CS', 'GM', 'AMC'])[(said + 1)::INTEGER] END AS node_type,
CASE k WHEN 0 THEN 'CS ' || code WHEN 1 THEN 'AMC ' || code WHEN 2 THEN (['CS ', 'GM ', 'AMC '])[(said + 1)::INTEGER] || code WHEN 5 THEN 'CS 25J' || pos ELSE 'Appendix ' || pos || CASE WHEN parent IS NOT NULL THEN ' to ' || parent ELSE '' END || ' – Notes' END AS reference_code
FROM p WHERE k <> 4 AND has_text""")
def topic_nodes(spark, sf_dir):
    """topics made from documents to nodes, types overridden, appendices under their articles."""
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    title = F.when(k == 0, F.concat(F.lit("CS 25."), n, F.lit(" Scope"))).when(k == 1, F.concat(F.lit("AMC 25."), n, F.lit(" Means"))).when(k == 2, F.concat(F.lit("25."), n, F.lit(" Bare"))).when(k == 3, F.concat(F.lit("Appendix "), n, F.lit(" – Notes"))).when(k == 4, "no code").otherwise(F.concat(F.lit("CS 25J"), n, F.lit(" Old")))
    said = F.when(k == 2, F.get(F.array(F.lit(None), F.lit("gm"), F.lit("AMC")), F.expr("cast(doc_id div 6 % 3 as int)")))
    d = v.read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("pos"), title.alias("title"), said.alias("type_of_content"), F.array(F.upper("lang")).alias("heading_stack"), (F.col("doc_id") % 11 != 0).alias("has_text"))
    return typed_topics(d, "CS").select("doc", "pos", "node_type", "reference_code")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ANNEX I / ' ELSE 'Easy Rules / ' END || upper(lang) || ' / ' || source AS path FROM documents""")
def hierarchy_paths(spark, sf_dir):
    """F8: paths from heading stacks with gaps and repeats."""
    stack = F.array(F.when(F.col("doc_id") % 3 == 0, "ANNEX I").otherwise(F.lit("")), F.upper("lang"), F.upper("lang"), F.lit(None).cast("string"), F.col("source"))
    return v.read(spark, sf_dir, "documents").select("doc_id", r.hierarchy_path(stack, F.lit("Easy Rules")).alias("path"))


def _blocks(spark, sf_dir):
    p = v.read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(<(?:h[1-3]|p|li)>[^<]*)"), F.lit(1))).alias("pos", "x"))
    tag = F.regexp_extract("x", "<(h[1-3]|p|li)>", 1)
    return p.select("page_id", "pos", F.when(tag.rlike("^h"), F.substring(tag, 2, 1).cast("int")).alias("level"), F.regexp_replace("x", "<[^>]*>", "").alias("body"))


_BLOCKS = r"""
b AS (SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN substring(tag, 2, 1)::INTEGER END AS level, regexp_replace(x, '<[^>]*>', '', 'g') AS body FROM (
  SELECT page_id, x, pos, regexp_extract(x, '<(h[1-3]|p|li)>', 1) AS tag FROM (
    SELECT page_id, UNNEST(l) AS x, UNNEST(range(0, len(l)))::INTEGER AS pos FROM (SELECT page_id, regexp_extract_all(html, '(<(?:h[1-3]|p|li)>[^<]*)', 1) AS l FROM pages))))"""


@query(f"""WITH {_BLOCKS}, w AS (SELECT *, MAX(CASE WHEN level = 1 THEN pos END) OVER o AS p1, MAX(CASE WHEN level = 2 THEN pos END) OVER o AS p2, MAX(CASE WHEN level = 3 THEN pos END) OVER o AS p3 FROM b
  WINDOW o AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT w.page_id, w.pos, x1.body AS h1, CASE WHEN COALESCE(p1 > p2, FALSE) THEN NULL ELSE x2.body END AS h2, CASE WHEN COALESCE(p1 > p3, FALSE) OR COALESCE(p2 > p3, FALSE) THEN NULL ELSE x3.body END AS h3
FROM w LEFT JOIN b x1 ON x1.page_id = w.page_id AND x1.pos = p1 LEFT JOIN b x2 ON x2.page_id = w.page_id AND x2.pos = p2 LEFT JOIN b x3 ON x3.page_id = w.page_id AND x3.pos = p3""")
def heading_carry(spark, sf_dir):
    """The headings in force at every block of a page."""
    return s.carried_headings(_blocks(spark, sf_dir), "page_id", "pos", F.col("level"), "body", 3).select("page_id", "pos", "h1", "h2", "h3")


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN parent END AS parent FROM (SELECT *,
LAST_VALUE(CASE WHEN role = 'user' THEN 'u' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM conversations)""")
def appendix_parent_asof(spark, sf_dir):
    """Each assistant turn (an appendix) to the user turn (an article) nearest before it."""
    df = s.nearest_before(v.read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.concat(F.lit("u"), F.col("turn")), "parent")
    return df.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.col("parent")).alias("parent"))


@query(f"""WITH {_BLOCKS}, g AS (SELECT *, level IS NOT NULL AS st, SUM((level IS NOT NULL)::INTEGER) OVER (PARTITION BY page_id ORDER BY pos)::BIGINT AS segment FROM b)
SELECT page_id, segment, MIN(pos) AS first_pos, MAX(CASE WHEN st THEN body END) AS heading, COALESCE(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT st), '') AS body, COUNT(*) FILTER (NOT st) AS n_lines FROM g GROUP BY 1, 2""")
def segment_bodies(spark, sf_dir):
    """A heading and the blocks up to the next one."""
    return s.segments(_blocks(spark, sf_dir), "page_id", "pos", F.col("level").isNotNull(), "body")


@query("""WITH r AS (SELECT conv_id, turn, role, SUM(c) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (
  SELECT *, CASE WHEN LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS c FROM conversations))
SELECT conv_id, run, MIN(role) AS role, COUNT(*) AS turns FROM r GROUP BY 1, 2""")
def role_runs(spark, sf_dir):
    """Stretches of equal neighbours."""
    return s.runs(v.read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"))


@query("""WITH s AS (SELECT l_orderkey // 4 AS doc, l_orderkey * 10 + l_linenumber AS pos, 'Part ' || l_partkey AS title,
  concat_ws('.', (l_orderkey % 4 + 1)::VARCHAR, CASE WHEN l_linenumber >= 2 THEN (l_partkey % 4 + 1)::VARCHAR END, CASE WHEN l_linenumber >= 3 THEN (l_partkey % 5 + 1)::VARCHAR END) AS code
  FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
a AS (SELECT doc, pos, k, array_to_string(string_split(code, '.')[1:k], '.') AS prefix FROM (SELECT *, UNNEST(range(1, len(string_split(code, '.')))) AS k FROM s)),
f AS (SELECT a.doc, a.pos, a.k, a.prefix, (SELECT ARG_MAX(s.title, s.pos) FROM s WHERE s.doc = a.doc AND s.code = a.prefix AND s.pos < a.pos) AS title FROM a),
p AS (SELECT doc, pos, string_agg(concat_ws(' ', prefix, title), ' / ' ORDER BY k) AS ancestors FROM f GROUP BY 1, 2)
SELECT s.doc, s.pos, s.code, s.title, COALESCE(p.ancestors, '') AS ancestors FROM s LEFT JOIN p ON p.doc = s.doc AND p.pos = s.pos""")
def ancestor_stack(spark, sf_dir):
    """Dotted section codes to the path of their ancestors, missing ones synthesised. Lines of one
    number of an order are one section."""
    li = v.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    code = F.concat_ws(".", (F.col("l_orderkey") % 4 + 1).cast("string"), *[F.when(F.col("l_linenumber") >= k, (F.col("l_partkey") % (k + 2) + 1).cast("string")) for k in (2, 3)])
    sections = li.select(F.expr("l_orderkey div 4").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), code.alias("code"), F.concat(F.lit("Part "), F.col("l_partkey")).alias("title"))
    return s.ancestor_paths(sections, "doc", "pos", "code", "title")
