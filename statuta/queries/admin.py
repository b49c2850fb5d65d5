"""Groups, links, upkeep and small listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.references import article_code
from ..operators import admin as a
from ..operators import sequences
from ..operators.graph import memberships
from ..schemas import NODE_TYPES
from ..sinks import tree_lines
from ..sources import views as v
from . import query

_GROUPS = v.NODES + """,
placed AS (SELECT node_id, split_part(hierarchy_path, ' / ', 1) AS root, split_part(hierarchy_path, ' / ', 2) AS subpart FROM nodes),
grp AS (SELECT DISTINCT md5('GROUP' || chr(1) || root || chr(1) || subpart) AS group_id, root, subpart FROM placed WHERE subpart LIKE 'SUBPART%')"""


@query(f"WITH {_GROUPS} SELECT group_id, root, subpart FROM grp")
def group_nodes(spark, sf_dir):
    """A11."""
    return a.groups(v.nodes(spark, sf_dir, text=False))


@query(f"WITH {_GROUPS} SELECT g.group_id AS source_node_id, p.node_id AS target_node_id, 'CONTAINS' AS relation FROM grp g JOIN placed p ON p.root = g.root AND starts_with(p.subpart, g.subpart)")
def contains_edges(spark, sf_dir):
    """J12."""
    n = v.nodes(spark, sf_dir, text=False)
    return a.contains_edges(a.groups(n), n)


@query(f"""WITH {v.NODES}, t AS (SELECT node_id, CASE pos % 3 WHEN 0 THEN 'see CS ' || bare_code || ' here' WHEN 1 THEN 'by ' || bare_code || ' and 1.1' ELSE content_text END AS body FROM nodes),
tok AS (SELECT DISTINCT node_id, UNNEST(regexp_extract_all(body, '((?:CS )?[0-9]+\\.[0-9]+)', 1)) AS token FROM t),
bare AS (SELECT bare_code AS token, ARG_MIN(reference_code, (CASE node_type WHEN 'IR' THEN 0 WHEN 'CS' THEN 0 WHEN 'AMC' THEN 1 ELSE 2 END, reference_code)) AS ref FROM nodes GROUP BY 1)
SELECT tok.node_id, tok.token, COALESCE(e.reference_code, b.ref) AS target_ref FROM tok LEFT JOIN (SELECT DISTINCT reference_code FROM nodes) e ON e.reference_code = tok.token LEFT JOIN bare b ON b.token = tok.token
WHERE COALESCE(e.reference_code, b.ref) IS NOT NULL""".replace("\\\\", "\\"))
def linkify(spark, sf_dir):
    """J24, F34."""
    n = v.nodes(spark, sf_dir)
    k = F.col("pos") % 3
    body = F.when(k == 0, F.concat(F.lit("see CS "), "bare_code", F.lit(" here"))).when(k == 1, F.concat(F.lit("by "), "bare_code", F.lit(" and 1.1"))).otherwise(F.col("content_text"))
    return a.links(n.select("node_id", body.alias("content_text")), n, r"(?:CS )?[0-9]+\.[0-9]+")


@query("""WITH n AS (SELECT 'Doc § ' || (p_partkey % 50) || '.' || (p_partkey % 7) AS ref FROM part),
c AS (SELECT regexp_extract(ref, '§\\s*([0-9.]+)', 1) AS code, MIN(ref) AS ref FROM n GROUP BY 1),
r AS (SELECT '§ ' || (l_partkey % 60) || '.' || (l_partkey % 7) AS s, CASE WHEN l_linenumber = 1 THEN 'CS 25.1' ELSE '§' || (l_suppkey % 50) || '.' || (l_suppkey % 7) END AS t FROM lineitem)
SELECT DISTINCT c.ref AS source_ref, CASE WHEN r.t = 'CS 25.1' THEN r.t ELSE d.ref END AS target_ref FROM r JOIN c ON c.code = substring(r.s, 3) LEFT JOIN c d ON d.code = substring(r.t, 2) WHERE r.t = 'CS 25.1' OR d.ref IS NOT NULL""".replace("\\\\", "\\"))
def section_resolve(spark, sf_dir):
    """J21."""
    p, li = v.read(spark, sf_dir, "part"), v.read(spark, sf_dir, "lineitem")
    c = lambda x, m: F.concat_ws(".", (F.col(x) % m).cast("string"), (F.col(x) % 7).cast("string"))
    nodes = p.select(F.concat(F.lit("Doc § "), c("p_partkey", 50)).alias("reference_code"))
    rel = li.select(F.concat(F.lit("§ "), c("l_partkey", 60)).alias("source_ref"), F.when(F.col("l_linenumber") == 1, "CS 25.1").otherwise(F.concat(F.lit("§"), c("l_suppkey", 50))).alias("target_ref"))
    return a.section_refs(rel, nodes)


@query("""SELECT s_suppkey AS id, s_name AS harvest_key, CASE WHEN s_suppkey % 3 = 0 THEN 'own' WHEN s_suppkey % 2 = 0 THEN '%' || substring(s_name || repeat('x', 70), 1, 60) || '%' END AS doc_title_pattern FROM supplier""")
def fill_title_pattern(spark, sf_dir):
    """K8."""
    s = v.read(spark, sf_dir, "supplier")
    entries = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("harvest_key"), F.when(F.col("s_suppkey") % 3 == 0, "own").alias("doc_title_pattern"))
    titles = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("harvest_key"), F.concat("s_name", F.repeat(F.lit("x"), F.lit(70))).alias("title"))
    return a.fill_pattern(entries, titles).select("id", "harvest_key", "doc_title_pattern")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 3 THEN 7 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier""")
def patch_source(spark, sf_dir):
    """K12."""
    return a.patched(v.read(spark, sf_dir, "supplier"), "s_suppkey", 3, {"s_name": "renamed", "s_nationkey": 7}, ("s_name", "s_nationkey"))


@query("SELECT 'events' AS \"table\", COUNT(*) AS rows FROM events UNION ALL SELECT 'documents', COUNT(*) FROM documents UNION ALL SELECT 'pages', COUNT(*) FROM pages")
def purge_counts(spark, sf_dir):
    """What a purge would remove."""
    return a.purged({t: v.read(spark, sf_dir, t) for t in ("events", "documents", "pages")})[0]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey END AS url, c_custkey % 3 = 0 AS smart, 1 + (c_custkey % 2 = 0)::INTEGER - 1 AS n_urls FROM customer""")
def url_flags(spark, sf_dir):
    """F29."""
    k = F.col("c_custkey")
    m = F.map_filter(F.create_map(F.lit("xml"), F.when(k % 2 == 0, F.concat(F.lit("u"), k)), F.lit("use_smart_parser"), F.when(k % 3 == 0, "TRUE").otherwise("false")), lambda _, x: x.isNotNull())
    urls, smart = a.split_flags(m)
    return v.read(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(urls, F.lit("xml")).alias("url"), smart.alias("smart"), F.size(urls).alias("n_urls"))


@query(f"""WITH {v.NODES} SELECT source_doc_id, ARG_MIN(node_id, (CASE WHEN node_type = 'IR' THEN 0 ELSE 1 END, pos)) AS node_id FROM nodes GROUP BY 1""")
def default_node(spark, sf_dir):
    """The node that a document opens at, its first IR or else its first."""
    return v.nodes(spark, sf_dir, text=False).groupBy("source_doc_id").agg(F.min_by("node_id", F.struct((F.col("node_type") != "IR").cast("int"), F.col("pos"))).alias("node_id"))


@query("SELECT event_type, ARG_MAX(event_id, (ts, event_id)) AS event_id, MAX(ts) AS fetched_at FROM events GROUP BY 1")
def latest_document(spark, sf_dir):
    """The newest of each key."""
    return v.read(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("fetched_at"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_tail(spark, sf_dir):
    """The latest 200 log lines, which is what the log keeps."""
    return v.read(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "ts", "event_type")


@query("SELECT c_mktsegment AS domain, COUNT(*) AS entries, COUNT(*) FILTER (c_acctbal > 0) AS indexed, MAX(c_nationkey) + 1 AS next_order FROM customer GROUP BY 1")
def catalog_by_domain(spark, sf_dir):
    """Entries by domain, how many are indexed, and the next sort order."""
    return v.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("domain")).agg(F.count("*").alias("entries"), F.count_if(F.col("c_acctbal") > 0).alias("indexed"), (F.max("c_nationkey") + 1).alias("next_order"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'App ' || p_partkey WHEN 1 THEN 'SP ' || p_partkey ELSE 'CS ' || p_partkey END AS label FROM part""")
def short_labels(spark, sf_dir):
    """F35."""
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    ref = F.when(k == 0, F.concat(F.lit("Appendix "), n, F.lit(" — Assessment"))).when(k == 1, F.concat(F.lit("SUBPART "), n, F.lit(" – General"))).otherwise(F.concat(F.lit("CS "), n))
    return v.read(spark, sf_dir, "part").select("p_partkey", a.short_label(ref).alias("label"))


@query(f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS d FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL THEN '' ELSE day(d) || ' ' || ({list(t.MONTHS_EN)})[month(d)] || ' ' || year(d) END AS shown, CASE WHEN d IS NULL THEN '—' ELSE ({list(t.MONTHS_FR)})[month(d)] || ' ' || year(d) END AS shown_fr FROM d""")
def display_dates(spark, sf_dir):
    """dates as they are shown, in English and in French."""
    d = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    return v.read(spark, sf_dir, "orders").select("o_orderkey", t.shown_day(d).alias("shown"), t.shown_month(d).alias("shown_fr"))


@query("""SELECT o_orderkey, COALESCE(MAP {'1-URGENT': 'cs25', '2-HIGH': 'part21'}[o_orderpriority], o_orderpriority) AS harvest_key FROM orders""")
def key_remap(spark, sf_dir):
    """F41."""
    m = F.create_map(F.lit("1-URGENT"), F.lit("cs25"), F.lit("2-HIGH"), F.lit("part21"))
    return v.read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(m, F.col("o_orderpriority")), F.col("o_orderpriority")).alias("harvest_key"))


@query(f"WITH {v.NODES} SELECT node_type, COUNT(*) AS n FROM nodes WHERE node_type IN ('IR', 'AMC', 'GM', 'CS', 'GROUP') GROUP BY 1")
def type_counts(spark, sf_dir):
    """A20, with the closed list of types."""
    return a.allowed(v.nodes(spark, sf_dir, text=False), "node_type", NODE_TYPES).groupBy("node_type").agg(F.count("*").alias("n"))


@query(f"""WITH {v.NODES} SELECT source_doc_id, bare_code AS article, node_id, reference_code, (ROW_NUMBER() OVER (PARTITION BY source_doc_id, bare_code ORDER BY CASE node_type WHEN 'IR' THEN 0 WHEN 'CS' THEN 0 WHEN 'AMC' THEN 1 ELSE 2 END, reference_code, node_id))::INTEGER AS place,
COUNT(*) OVER (PARTITION BY source_doc_id, bare_code) AS members FROM nodes""")
def article_groups(spark, sf_dir):
    """An article's nodes in display order."""
    n = v.nodes(spark, sf_dir, text=False).select("source_doc_id", article_code(F.col("reference_code")).alias("article"), "node_type", "reference_code", "node_id")
    return memberships(n, ["source_doc_id", "article"])


@query("""WITH m AS (SELECT doc_id, UNNEST(range(0, len(string_split(text, chr(10)))))::INTEGER AS pos FROM documents)
SELECT doc_id, (pos // 4)::BIGINT AS list, COUNT(*) AS items FROM m WHERE pos % 4 IN (1, 2) GROUP BY 1, 2""")
def dash_lists(spark, sf_dir):
    """Neighbouring dash paragraphs are one list."""
    d = v.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    d = d.withColumn("dash", (F.col("pos") % 4).isin(1, 2))
    r = sequences.runs(d, ["doc_id"], "pos", "dash").where("dash")
    return r.groupBy("doc_id", "run").agg(F.min("pos").alias("p"), F.count("*").alias("items")).select("doc_id", F.expr("p div 4").alias("list"), "items")


@query(f"""WITH {v.NODES}, t AS (SELECT source_doc_id AS path, split_part(hierarchy_path, ' / ', 3) AS heading, pos, title, content_text FROM nodes),
f AS (SELECT *, MIN(pos) OVER (PARTITION BY path, heading) AS first FROM t), w AS (SELECT *, LAG(first) OVER o AS b, LEAD(first) OVER o AS a FROM f WINDOW o AS (PARTITION BY path ORDER BY first, pos))
SELECT path, first, pos, md5(CASE WHEN b IS NULL THEN '{{"path":' || to_json(path) || ',"toc":[' ELSE '' END || CASE WHEN b IS DISTINCT FROM first THEN '{{"heading":' || to_json(heading) || ',"topics":[' ELSE '' END
  || '{{"pos":' || pos || ',"title":' || to_json(title) || ',"content_text":' || to_json(content_text) || '}}' || CASE WHEN a IS NULL THEN ']}}]}}' WHEN a <> first THEN ']}},' ELSE ',' END) AS line_md5 FROM w""")
def json_tree(spark, sf_dir):
    """Every document as nested JSON, a line a topic."""
    n = v.nodes(spark, sf_dir)
    rows = tree_lines(n.select(F.col("source_doc_id").alias("path"), F.split_part("hierarchy_path", F.lit(" / "), F.lit(3)).alias("heading"), "pos", "title", "content_text"))
    return rows.select("path", "first", "pos", F.md5("line").alias("line_md5"))
