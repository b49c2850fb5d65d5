"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import page_kind as kind_of
from ..functions.text import paragraph_level, provider, sniffed
from ..sinks import paragraph_rows
from ..operators.graph import base_article_edges
from ..sources import json_docs, landed
from ..sources import views as v
from . import query


def _as_json_docs(spark, sf_dir):
    """Conversations as documents of the intermediate form."""
    c = v.read(spark, sf_dir, "conversations")
    node = F.struct(F.when(F.col("role") == "user", "IR").when(F.col("role") == "system", "GM").otherwise("AMC").alias("type"), F.concat(F.col("conv_id"), F.lit("."), F.col("turn")).alias("ref"), F.col("role").alias("title"), F.lit("x").alias("hierarchy"), F.col("text"), F.lit(None).cast("string").alias("html"), F.lit("s").alias("source"))
    rel = F.struct(F.concat(F.col("conv_id"), F.lit("."), F.col("turn")).alias("from"), F.when(F.col("turn") > 0, F.concat(F.col("conv_id"), F.lit("."), F.col("turn") - 1)).alias("to"), F.lit("guidance for").alias("label"), F.when(F.col("turn") % 2 == 0, 0.5).alias("confidence"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.collect_list(rel).alias("relations")).select(F.concat(F.lit("doc"), F.col("conv_id")).alias("title"), F.lit("1").alias("version"), "nodes", "relations")


@query("""SELECT 'doc' || conv_id AS doc_title, CASE role WHEN 'user' THEN 'IR' WHEN 'system' THEN 'GM' ELSE 'AMC' END AS node_type, conv_id || '.' || turn AS reference_code, substring(sha256(text), 1, 16) AS content_hash FROM conversations""")
def json_ingest(spark, sf_dir):
    """Nodes of intermediate documents."""
    return json_docs.node_rows(_as_json_docs(spark, sf_dir)).select("doc_title", "node_type", "reference_code", "content_hash")


@query("""SELECT 'doc' || conv_id AS doc_title, conv_id || '.' || turn AS source_ref, conv_id || '.' || (turn - 1) AS target_ref, 'GUIDANCE_FOR' AS relation, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, 'llm-extracted' AS notes FROM conversations WHERE turn > 0""")
def json_relations(spark, sf_dir):
    """Their relations; those without an end go."""
    return json_docs.relation_rows(_as_json_docs(spark, sf_dir))


@query("""SELECT doc_id::VARCHAR AS rel_id, 'data:image/png;base64,' || base64(encode(text)) AS uri FROM documents WHERE doc_id % 4 <> 0""")
def image_uri(spark, sf_dir):
    """S6."""
    d = v.read(spark, sf_dir, "documents")
    target = F.concat(F.lit("media/"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, ".emf").otherwise(".png"))
    media = d.select(target.alias("target"), F.lit("image/png").alias("content_type"), F.encode("text", "UTF-8").alias("content"))
    out = landed.image_uris(d.select(F.col("doc_id").cast("string").alias("rel_id"), target.alias("target")), media)
    return out.select("rel_id", F.regexp_replace("uri", r"\r\n", "").alias("uri"))


@query(r"""SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages""")
def html_title(spark, sf_dir):
    """Title and host of pages, and their list items."""
    return v.read(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_size * 10 - 100 > 200 THEN 'consolidated' WHEN p_size * 10 - 100 > 0 THEN 'delta' ELSE 'unknown' END AS kind FROM part")
def page_kind(spark, sf_dir):
    """S15."""
    return v.read(spark, sf_dir, "part").select("p_partkey", kind_of(F.col("p_size") * 10 - 100).alias("kind"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'html' ELSE 'zip' END AS kind FROM pages""")
def sniff_format(spark, sf_dir):
    """By magic bytes and by type."""
    content = F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-1.7").otherwise(""), F.col("html")), "UTF-8")
    kind = F.when(F.col("page_id") % 3 == 1, "text/HTML; charset=utf-8")
    return v.read(spark, sf_dir, "pages").select("page_id", sniffed(content, kind).alias("kind"))


@query(r"""WITH p AS (SELECT doc_id, lang, source, UNNEST(string_split(text, chr(10))) AS body, UNNEST(range(0, len(string_split(text, chr(10)))))::INTEGER AS para FROM documents)
SELECT 'e' || doc_id AS erules_id, source AS title, lang AS type_of_content, source AS regulatory_source, NULL::VARCHAR AS amended_by, para, body AS text FROM p WHERE trim(body) <> ''""")
def csv_paragraphs(spark, sf_dir):
    """One row a paragraph with its topic's attributes."""
    d = v.read(spark, sf_dir, "documents")
    return paragraph_rows(d.select(F.concat(F.lit("e"), F.col("doc_id")).alias("erules_id"), F.col("source").alias("title"), F.col("lang").alias("type_of_content"), F.col("source").alias("regulatory_source"), F.lit(None).cast("string").alias("amended_by"), F.col("text").alias("content_text")))


@query("""SELECT o_orderkey, UNNEST([o_orderstatus, o_orderpriority, 'x']) AS id, UNNEST(['a', 'b', 'c']) AS pat FROM orders""")
def unnest_arrays(spark, sf_dir):
    """Parallel arrays as rows."""
    a = F.arrays_zip(F.array("o_orderstatus", "o_orderpriority", F.lit("x")).alias("id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("pat"))
    return v.read(spark, sf_dir, "orders").select("o_orderkey", F.explode(a).alias("z")).select("o_orderkey", "z.id", "z.pat")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'html' ELSE 'pdf' END AS format, CASE c_custkey % 4 WHEN 0 THEN 'j' WHEN 1 THEN 'x' WHEN 2 THEN 'h' ELSE 'p' END || c_custkey AS url FROM customer""")
def best_url(spark, sf_dir):
    """The best format that a source has."""
    k = F.col("c_custkey")
    u = F.map_filter(F.create_map(*[x for f, n in (("json", 0), ("xml", 1), ("html", 2), ("pdf", 3)) for x in (F.lit(f), F.when(k % 4 <= n, F.concat(F.lit(f[0]), k)))]), lambda _, x: x.isNotNull())
    return v.read(spark, sf_dir, "customer").select("c_custkey", landed.best_url(u).alias("b")).select("c_custkey", "b.format", "b.url")


@query("""SELECT doc_id, SUM(CASE WHEN regexp_matches(l, '^\\s*\\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\\)') THEN 3 WHEN regexp_matches(l, '^\\s*\\([a-z]\\)') THEN 1 WHEN regexp_matches(l, '^\\s*\\(\\d+\\)') THEN 2 WHEN regexp_matches(l, '^\\s*[—–-]\\s') THEN 4 ELSE 0 END)::BIGINT AS levels
FROM (SELECT doc_id, UNNEST(list_transform(string_split(text, chr(10)), lambda x, i: (['(a) ', '(1) ', '(ii) ', '- ', ''])[(i - 1) % 5 + 1] || x)) AS l FROM documents) GROUP BY doc_id""".replace("\\\\", "\\"))
def paragraph_levels(spark, sf_dir):
    """F33."""
    marks = F.array(*[F.lit(m) for m in ("(a) ", "(1) ", "(ii) ", "- ", "")])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(marks, (i % 5 + 1).cast("int")), x))
    return v.read(spark, sf_dir, "documents").select("doc_id", F.aggregate(F.transform(lines, paragraph_level), F.lit(0), lambda a, x: a + x).cast("long").alias("levels"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'openai' WHEN 2 THEN 'local' ELSE 'other' END AS provider FROM supplier""")
def chat_provider(spark, sf_dir):
    """F42."""
    url = F.element_at(F.array(*[F.lit(u) for u in ("https://api.GROQ.com/v1", "https://api.openai.com", "http://localhost:11434", "https://example.org")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return v.read(spark, sf_dir, "supplier").select("s_suppkey", provider(url).alias("provider"))


def _packages(spark, sf_dir):
    """Conversations as flat packages: a table of contents and a content control a turn, every third in another."""
    w, er = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://www.easa.europa.eu/erules-export"
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    topic = F.concat(F.lit('<er:topic sdt-id="'), F.col("turn"), F.lit('" source-title="T '), F.col("turn"), F.lit('" ERulesId="e'), F.col("turn"), F.lit('"/>'))
    alias = F.when(F.col("turn") % 2 == 0, "topic").otherwise("other")
    body = F.concat(F.lit('<w:p><w:r><w:t>'), safe, F.lit("</w:t></w:r></w:p>"))
    inner = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('<w:sdt><w:sdtPr><w:alias w:val="topic"/><w:id w:val="in'), F.col("turn"), F.lit('"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:sdtContent></w:sdt>'))).otherwise("")
    sdt = F.concat(F.lit('<w:sdt><w:sdtPr><w:alias w:val="'), alias, F.lit('"/><w:id w:val="'), F.col("turn"), F.lit('"/></w:sdtPr><w:sdtContent>'), body, inner, F.lit("</w:sdtContent></w:sdt>"))
    g = v.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(topic)), "").alias("t"), F.array_join(F.sort_array(F.collect_list(sdt)), "").alias("s"))
    xml = F.concat(F.lit(f'<p xmlns:w="{w}" xmlns:er="{er}"><er:toc><er:heading title="ANNEX I"/>'), F.col("t"), F.lit("</er:toc>"), F.col("s"), F.lit("</p>"))
    return landed.package_rows(g.select(F.concat(F.lit("doc"), F.col("conv_id")).alias("path"), F.encode(xml, "UTF-8").alias("content")))


_NORMAL = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"


@query(f"""WITH c AS (SELECT *, {_NORMAL} AS body FROM conversations)
SELECT 'doc' || conv_id AS path, turn::VARCHAR AS sdt_id, 'T ' || turn AS title, 'e' || turn AS erules_id, CASE WHEN turn % 3 = 0 THEN concat_ws(chr(10), NULLIF(body, ''), 'inner') ELSE body END AS content_text FROM c WHERE turn % 3 = 0 OR body <> ''""")
def xml_topics(spark, sf_dir):
    """Conversations as flat packages, read back as topics with their text."""
    return landed.topics_with_text(_packages(spark, sf_dir)).select("path", "sdt_id", "title", "erules_id", "content_text")


@query(r"""WITH c AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)
SELECT 'doc' || conv_id AS path, turn::VARCHAR AS sdt_id, 0 AS para, body AS text, 'e' || turn AS erules_id FROM c WHERE turn % 2 = 0 AND body <> '' UNION ALL SELECT 'doc' || conv_id, 'in' || turn, 0, 'inner', NULL FROM c WHERE turn % 3 = 0""")
def pruned_packages(spark, sf_dir):
    """Paragraphs of the topics' controls alone, with what the contents say of them."""
    return landed.pruned(_packages(spark, sf_dir)).select("path", "sdt_id", "para", "text", "erules_id")


@query(f"""WITH {v.EDGES} SELECT n.source_doc_id AS title, COUNT(*) AS n_nodes, md5(string_agg(n.reference_code, ',' ORDER BY n.pos)) AS refs_md5, COALESCE(ANY_VALUE(r.n), 0) AS n_relations
FROM nodes n LEFT JOIN (SELECT m.source_doc_id, COUNT(*) AS n FROM typed t JOIN nodes m ON m.node_id = t.source_node_id GROUP BY 1) r ON r.source_doc_id = n.source_doc_id GROUP BY 1""")
def json_documents(spark, sf_dir):
    """Documents in the intermediate form, their nodes in order, with the relations that leave them."""
    n = v.nodes(spark, sf_dir)
    ends = base_article_edges(v.nodes(spark, sf_dir, text=False)).join(n.select(F.col("node_id").alias("source_node_id"), "source_doc_id"), "source_node_id")
    rows = json_docs.documents(n, ends.withColumn("confidence", F.lit(None).cast("double")))
    return rows.select("title", F.size("nodes").cast("long").alias("n_nodes"), F.md5(F.array_join(F.transform("nodes", lambda x: x["ref"]), ",")).alias("refs_md5"), F.size("relations").cast("long").alias("n_relations"))
