"""Structure of laid-out pages, plain paragraphs, and what models wrote about them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import headings as h
from ..operators import blocks as b
from ..operators import graph as g
from ..sources import views as v
from . import query


def _blocks(spark, sf_dir):
    """Each line of a document as a block of text behind a block that is a heading, or noise."""
    i = F.col("i")
    line = v.read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = (i + F.col("doc_id")) % 6
    head = (
        F.when(k == 0, F.concat(F.lit("S UBPART  "), F.char(65 + F.col("doc_id") % 3)))
        .when(k == 1, F.concat(F.lit("SECTION "), i))
        .when(k == 2, F.concat(F.lit("CS 25."), 100 + i % 7, F.lit(" Scope of "), "lang"))
        .when(k == 3, F.concat(F.lit("GENERAL\nAMC 25-"), i % 5, F.lit(" Means\tED 2022")))
        .when(k == 4, "Page 3 of 9")
        .otherwise("NOTE")
    )
    size = F.element_at(F.array(*[F.lit(x) for x in (20.0, 18.0, 9.0, 13.5, 12.0, 20.0)]), (k + 1).cast("int"))
    heads = line.select("doc_id", (2 * i).alias("pos"), head.alias("text"), size.alias("size"), (k != 4).alias("bold"))
    small = F.when(i % 4 == 0, 8.0).when(i % 4 == 1, 9.5).otherwise(10.0)
    return heads.unionByName(line.select("doc_id", (2 * i + 1).alias("pos"), F.col("line").alias("text"), small.alias("size"), F.lit(False).alias("bold")))


_NOISE = h.PAGE_NOISE.removeprefix("(?i)").replace("'", "''")
_STRUCTURED = rf"""
lines AS (SELECT doc_id, lang, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
heads AS (SELECT *, (i + doc_id) % 6 AS k FROM lines),
blocks AS (
  SELECT doc_id, 2 * i AS pos, CASE k WHEN 0 THEN 'S UBPART  ' || chr((65 + doc_id % 3)::INTEGER) WHEN 1 THEN 'SECTION ' || i WHEN 2 THEN 'CS 25.' || (100 + i % 7) || ' Scope of ' || lang
    WHEN 3 THEN 'GENERAL' || chr(10) || 'AMC 25-' || (i % 5) || ' Means' || chr(9) || 'ED 2022' WHEN 4 THEN 'Page 3 of 9' ELSE 'NOTE' END AS text, ([20.0, 18.0, 9.0, 13.5, 12.0, 20.0])[(k + 1)::INTEGER] AS size, k <> 4 AS bold FROM heads
  UNION ALL SELECT doc_id, 2 * i + 1, line, CASE i % 4 WHEN 0 THEN 8.0 WHEN 1 THEN 9.5 ELSE 10.0 END, FALSE FROM lines),
x AS (SELECT *, regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '\b([A-Z]) ([A-Z]{{2,}})\b', '\1\2', 'g') AS label, bold AND size >= 17.5 AS large FROM blocks WHERE NOT regexp_matches(trim(text), '{_NOISE}', 'i')),
y AS (SELECT *, COALESCE(BOOL_OR(large AND regexp_matches(label, '\b(SUBPART|SECTION|GENERAL|CHAPTER)\b', 'i')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS opened FROM x),
z AS (SELECT *, CASE WHEN opened AND bold AND regexp_matches(trim(text), '^CS 25\.') THEN 'article' WHEN large THEN 'structure' WHEN opened AND bold AND size >= 13 AND regexp_matches(text, '\nAMC ') THEN 'article' END AS head FROM y),
s AS (SELECT *, LAST_VALUE(CASE head WHEN 'article' THEN pos WHEN 'structure' THEN -1 END IGNORE NULLS) OVER o AS place, MAX(CASE WHEN head = 'structure' AND size >= 19.5 THEN pos END) OVER o AS sub_at, MAX(CASE WHEN head = 'structure' AND size < 19.5 THEN pos END) OVER o AS sec_at
  FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT s.doc_id, s.pos, s.text, s.size, COALESCE(s.head, CASE WHEN s.place >= 0 AND s.size > 9.5 THEN 'body' END) AS role, NULLIF(s.place, -1) AS article, u.label AS subpart, CASE WHEN s.sub_at IS NULL OR s.sec_at > s.sub_at THEN c.label END AS section, NOT s.opened AS in_toc
  FROM s LEFT JOIN x u ON u.doc_id = s.doc_id AND u.pos = s.sub_at LEFT JOIN x c ON c.doc_id = s.doc_id AND c.pos = s.sec_at)"""


@query(f"WITH {_STRUCTURED} SELECT doc_id, pos, role, article, subpart, section, in_toc FROM st")
def page_structure(spark, sf_dir):
    """What every block is, and which subpart, section and article are in force there."""
    return b.structured(_blocks(spark, sf_dir), "doc_id", "pos").select("doc_id", "pos", "role", "article", "subpart", "section", "in_toc")


@query(rf"""WITH {_STRUCTURED},
a AS (SELECT doc_id, article AS pos, MAX(CASE WHEN role = 'article' THEN regexp_extract(text, '(?:CS|AMC) 25[^\t]*') END) AS heading, MAX(CASE WHEN role = 'article' THEN concat_ws(' / ', 'Doc', subpart, section) END) AS hierarchy_path,
  trim(string_agg(trim(text), chr(10) ORDER BY pos) FILTER (role = 'body')) AS content FROM st WHERE role IN ('article', 'body') GROUP BY 1, 2),
r AS (SELECT *, split_part(heading, ' ', 1) AS node_type, split_part(heading, ' ', 1) || ' ' || split_part(heading, ' ', 2) AS reference_code, regexp_extract(heading, '^\S+ \S+ (.*)$', 1) AS title FROM a WHERE content <> '')
SELECT doc_id, pos, node_type, reference_code, title, hierarchy_path, md5(content) AS content_md5 FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, node_type, reference_code ORDER BY pos DESC) = 1""")
def page_articles(spark, sf_dir):
    """Articles of pages with their place and text."""
    a = b.articles(_blocks(spark, sf_dir).withColumn("doc", F.lit("Doc")), "doc_id", "pos", "doc")
    return a.select("doc_id", "pos", "node_type", "reference_code", "title", "hierarchy_path", F.md5("content_text").alias("content_md5"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 3 AS bold, l_partkey % 70 AS n, CASE l_suppkey % 5 WHEN 0 THEN ' ft' WHEN 1 THEN '' WHEN 2 THEN '.2 Aim ..... 9' WHEN 3 THEN '.' || (l_suppkey % 9) || ' Aim' ELSE ' Aim' END AS tail FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT bold OR tail IN (' ft', '.2 Aim ..... 9') THEN NULL WHEN starts_with(tail, '.') THEN n || split_part(tail, ' ', 1) WHEN n <= 50 THEN n::VARCHAR END AS number FROM t""")
def numbered_headings(spark, sf_dir):
    """numbers of lines that are headings."""
    k = F.col("l_suppkey") % 5
    tail = F.when(k == 0, " ft").when(k == 1, "").when(k == 2, ".2 Aim ..... 9").when(k == 3, F.concat(F.lit("."), F.col("l_suppkey") % 9, F.lit(" Aim"))).otherwise(" Aim")
    line = F.concat(F.col("l_partkey") % 70, tail)
    return v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.numbered_heading(line, F.col("l_linenumber") != 3).alias("number"))


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
t AS (SELECT doc_id, i, trim(CASE WHEN i % 7 = 6 THEN '' WHEN i % 5 IN (2, 3) THEN replace(line, ' ', chr(9)) WHEN i % 4 = 1 THEN (['(a) ', '(iv) ', '(2) ', 'b. ', 'Note: ', '(xyz) '])[(i // 4 % 6 + 1)::INTEGER] || line WHEN i % 11 = 8 THEN (i % 3) || ' General aims' ELSE line END) AS line FROM l),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN contains(line, chr(9)) THEN 'table' ELSE 'text' END AS kind FROM t),
e AS (SELECT *, SUM((was IS DISTINCT FROM kind OR (kind = 'text' AND (regexp_matches(line, '{'|'.join(b.PARAGRAPH_START)}') OR regexp_matches(line, '{b.NOTE_START}', 'i'))))::BIGINT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS element FROM (SELECT *, LAG(kind) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM k)),
p AS (SELECT doc_id, element, kind, CASE kind WHEN 'table' THEN string_agg(line, chr(10) ORDER BY i) ELSE string_agg(line, ' ' ORDER BY i) END AS body FROM e WHERE kind <> 'blank' GROUP BY 1, 2, 3),
e2 AS (SELECT doc_id, element, CASE WHEN kind = 'text' AND regexp_matches(body, '{b.SECTION_LINE}') THEN 'heading' ELSE kind END AS kind, body FROM p)
SELECT doc_id, element, kind, md5(body) AS body_md5, CASE WHEN kind <> 'text' THEN kind WHEN regexp_matches(body, '^\([a-z]{{1,3}}\)\s') AND regexp_matches(body, '^\((i|ii|iii|iiii|iv|v|vi|vii|viii|ix|x|xx|xxx)\)\s') THEN 'indent-3'
  WHEN regexp_matches(body, '^([a-z]\.\s|[a-z]\)|\([a-z]{{1,3}}\)\s)') THEN 'indent-1' WHEN regexp_matches(body, '^\([0-9]+\)\s') THEN 'indent-2' WHEN regexp_matches(body, '^note\b', 'i') THEN 'note' ELSE 'plain' END AS shown,
  CASE WHEN kind = 'table' THEN list_sum(list_transform(string_split(body, chr(10)), lambda x: len(string_split(x, chr(9)))))::BIGINT END AS n_cells FROM e2""")
def plain_paragraphs(spark, sf_dir):
    """Paragraphs, tables and headings of plain lines."""
    i = F.col("i")
    line = F.when(i % 7 == 6, "").when((i % 5).isin(2, 3), F.translate("line", " ", "\t")).when(i % 4 == 1, F.concat(F.element_at(F.array(*[F.lit(x) for x in ("(a) ", "(iv) ", "(2) ", "b. ", "Note: ", "(xyz) ")]), F.expr("cast(i div 4 % 6 + 1 as int)")), "line")).when(i % 11 == 8, F.concat(i % 3, F.lit(" General aims"))).otherwise(F.col("line"))
    d = v.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", line.alias("line"))
    return b.paragraphs(d, "doc_id", "i", "line").select("doc_id", "element", "kind", F.md5("body").alias("body_md5"), "shown", F.when(F.col("kind") == "table", F.aggregate("cells", F.lit(0).cast("long"), lambda n, r: n + F.size(r))).alias("n_cells"))


@query("""WITH t AS (SELECT o_orderkey, (['cs', 'Draft AMC1', 'gm note', 'CS-25', 'rule', 'IR'])[(o_custkey % 6 + 1)::INTEGER] AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 'cs' THEN 'CS' WHEN 'Draft AMC1' THEN 'AMC' WHEN 'gm note' THEN 'GM' WHEN 'CS-25' THEN 'CS' ELSE 'IR' END AS node_type FROM t""")
def coerced_types(spark, sf_dir):
    """F15."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("cs", "Draft AMC1", "gm note", "CS-25", "rule", "IR")]), (F.col("o_custkey") % 6 + 1).cast("int"))
    return v.read(spark, sf_dir, "orders").select("o_orderkey", h.coerced_type(kind).alias("node_type"))


@query("""WITH t AS (SELECT *, CASE WHEN role = 'user' THEN 'AMC 25.' || turn END AS own, turn % 4 = 1 AS named FROM conversations),
p AS (SELECT *, LAST_VALUE(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM t)
SELECT conv_id, turn, CASE WHEN own IS NOT NULL THEN own WHEN named THEN 'Appendix ' || turn || ' to CS 25.9 – Means' WHEN parent IS NULL THEN 'Appendix ' || turn || ' – Means' ELSE 'Appendix ' || turn || ' to ' || parent || ' – Means' END AS reference_code FROM p""")
def appendix_references(spark, sf_dir):
    """appendices that do not say of what get the nearest article before them."""
    from ..operators.sequences import nearest_before

    own = F.when(F.col("role") == "user", F.concat(F.lit("AMC 25."), "turn"))
    c = nearest_before(v.read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", own, "parent")
    ref = F.coalesce(own, F.concat(F.lit("Appendix "), "turn", F.when(F.col("turn") % 4 == 1, " to CS 25.9").otherwise(""), F.lit(" – Means")))
    return c.select("conv_id", "turn", h.with_parent(ref, F.col("parent")).alias("reference_code"))


@query(rf"""WITH {v.NODE_ROWS}, t AS (SELECT reference_code AS source_ref, 'see AMC ' || bare_code || '(a), cs 25.' || (pos % 9) || ' and ' || reference_code || '. ' || content_text AS body FROM node_rows),
r AS (SELECT source_ref, trim(UNNEST(regexp_extract_all(body, '\b((?:CS|AMC|GM|IR)\s+[\w.\-]+(?:\([^)]*\))*)\b', 1, 'i'))) AS target_ref FROM t)
SELECT DISTINCT source_ref, target_ref, 'REFERS_TO' AS relation FROM r WHERE target_ref <> source_ref""")
def text_references(spark, sf_dir):
    """References that texts name."""
    n = v.node_rows(spark, sf_dir)
    body = F.concat(F.lit("see AMC "), "bare_code", F.lit("(a), cs 25."), F.col("pos") % 9, F.lit(" and "), "reference_code", F.lit(". "), "content_text")
    return g.text_references(n.select("reference_code", body.alias("content_text")))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN turn % 10 / 10.0::DOUBLE END AS confidence FROM conversations) SELECT * FROM r WHERE confidence IS NULL OR confidence >= 0.7""")
def confident_relations(spark, sf_dir):
    """An optional step."""
    c = v.read(spark, sf_dir, "conversations")
    return g.confident(c.select("conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("turn") % 10 / 10.0).alias("confidence")))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN turn + 1 WHEN 1 THEN 7 ELSE 5 END::INTEGER AS first, CASE (conv_id + turn) % 4 WHEN 0 THEN 2 ELSE 5 END AS second FROM conversations""")
def model_scores(spark, sf_dir):
    """scores that a model wrote, with fences, without some, or not as JSON at all."""
    c = v.read(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    answer = F.when(k == 0, F.concat(F.lit('```json\n{"1": '), F.col("turn") + 1, F.lit(', "2": 2}\n```'))).when(k == 1, '{"1": 7}').when(k == 2, "I would say 9").otherwise('{"1": "high"}')
    c = c.withColumn("scores", h.model_scores(answer))
    return c.select("conv_id", "turn", h.score_of(F.col("scores"), F.lit(1)).alias("first"), h.score_of(F.col("scores"), F.lit(2)).alias("second"))


@query(f"""WITH {v.NODE_ROWS}, r AS (SELECT source_doc_id, pos, '[' || reference_code || ']' || CASE WHEN pos % 2 = 0 THEN ' — ' || title ELSE '' END || chr(10) || substring(content_text, 1, 2000) AS x, ROW_NUMBER() OVER (PARTITION BY source_doc_id ORDER BY pos) AS k FROM node_rows)
SELECT source_doc_id, md5(string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS context_md5 FROM r WHERE k <= 6 GROUP BY 1""")
def answer_context(spark, sf_dir):
    """the context of an answer from the six best hits of each source, here its first nodes."""
    n = v.node_rows(spark, sf_dir)
    hits = n.withColumn("k", F.row_number().over(Window.partitionBy("source_doc_id").orderBy("pos"))).where("k <= 6")
    shown = h.excerpt(F.col("reference_code"), F.when(F.col("pos") % 2 == 0, F.col("title")), F.col("content_text"))
    g6 = hits.groupBy("source_doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("x")))).alias("b"))
    return g6.select("source_doc_id", F.md5(F.array_join("b.x", "\n\n---\n\n")).alias("context_md5"))
