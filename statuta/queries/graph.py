"""Nodes, neighbours and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.references import CODE, article_code
from ..operators import graph as g
from ..operators.dedup import first_wins, last_wins, numbered
from ..sources import views as v
from ..sources.landed import table_sizes
from . import query


@query(f"""WITH {v.NODES}, f AS (SELECT * FROM nodes WHERE node_type = 'CS' AND hierarchy_path LIKE 'Corpus src1%' AND (reference_code ILIKE '%2%' OR title ILIKE '%th%'))
SELECT node_id, node_type, reference_code, title, hierarchy_path, source_doc_id, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY hierarchy_path, reference_code, node_id LIMIT 50 OFFSET 5""")
def nodes_list(spark, sf_dir):
    """A page of a filtered listing and the total; the limit is the feature."""
    n = v.nodes(spark, sf_dir).where("node_type = 'CS'").where(F.col("hierarchy_path").like("Corpus src1%")).where(F.col("reference_code").ilike("%2%") | F.col("title").ilike("%th%"))
    n = n.select("node_id", "node_type", "reference_code", "title", "hierarchy_path", "source_doc_id")
    total = n.agg(F.count("*").alias("total"))
    return n.orderBy("hierarchy_path", "reference_code", "node_id").offset(5).limit(50).join(F.broadcast(total))


@query(f"WITH {v.NODES} SELECT node_id, node_type, reference_code, content_text FROM nodes WHERE node_id = 'n0'")
def node_lookup(spark, sf_dir):
    """P6."""
    return v.nodes(spark, sf_dir).where("node_id = 'n0'").select("node_id", "node_type", "reference_code", "content_text")


@query(f"""WITH {v.EDGES} SELECT e.source_node_id AS node_id, e.relation, m.node_id AS neighbour_id, m.node_type AS neighbour_type, m.reference_code AS neighbour_ref
FROM edges e JOIN nodes m ON m.node_id = e.target_node_id JOIN nodes s ON s.node_id = e.source_node_id AND s.node_type = 'AMC'""")
def neighbors_out(spark, sf_dir):
    """What every AMC node points to."""
    n = v.nodes(spark, sf_dir, text=False)
    return g.neighbours(v.edges(spark, sf_dir), n, n.where("node_type = 'AMC'"), "out")


@query(f"""WITH {v.EDGES} SELECT e.target_node_id AS node_id, e.relation, m.node_id AS neighbour_id, m.node_type AS neighbour_type, m.reference_code AS neighbour_ref
FROM edges e JOIN nodes m ON m.node_id = e.source_node_id JOIN nodes s ON s.node_id = e.target_node_id AND s.node_type IN ('IR', 'CS') WHERE e.relation <> 'REFERENCES'""")
def neighbors_in(spark, sf_dir):
    """What explains every base article."""
    n = v.nodes(spark, sf_dir, text=False)
    return g.neighbours(v.edges(spark, sf_dir).where("relation <> 'REFERENCES'"), n, n.where("node_type IN ('IR', 'CS')"), "in")


@query(f"""WITH {v.EDGES} SELECT e.target_node_id AS node_id, e.relation, CASE e.relation WHEN 'ACCEPTABLE_MEANS' THEN 2 WHEN 'GUIDANCE_FOR' THEN 3 WHEN 'REFERENCES' THEN 4 ELSE 9 END AS relation_rank, COUNT(*) OVER (PARTITION BY e.target_node_id, e.relation) AS neighbours,
  (ROW_NUMBER() OVER (PARTITION BY e.target_node_id, e.relation ORDER BY CASE m.node_type WHEN 'IR' THEN 0 WHEN 'CS' THEN 0 WHEN 'AMC' THEN 1 WHEN 'GM' THEN 2 ELSE 9 END, m.reference_code, m.node_id))::INTEGER AS place, m.reference_code AS neighbour_ref, m.node_id AS neighbour_id
FROM edges e JOIN nodes m ON m.node_id = e.source_node_id""")
def neighbors_by_relation(spark, sf_dir):
    """Incoming neighbours by relation in the fixed order, items by type."""
    n = v.nodes(spark, sf_dir, text=False)
    return g.ranked_neighbours(g.neighbours(v.edges(spark, sf_dir), n, F.lit(True), "in"))


@query(f"WITH {v.EDGES} SELECT source_node_id, source_ref, target_node_id, target_ref, relation FROM typed")
def base_article_edges(spark, sf_dir):
    """J15."""
    return g.base_article_edges(v.nodes(spark, sf_dir, text=False))


@query(f"""WITH {v.NODES}, parsed AS (
  SELECT reference_code AS source_ref, bare_code AS target_ref, 'IMPLEMENTS' AS relation FROM node_rows UNION ALL SELECT reference_code, 'CS ' || bare_code, 'REQUIRES' FROM node_rows),
best AS (SELECT reference_code, ARG_MIN(node_id, (CASE node_type WHEN 'IR' THEN 1 WHEN 'AMC' THEN 2 WHEN 'GM' THEN 3 ELSE 4 END, node_id)) AS id FROM nodes GROUP BY reference_code)
SELECT DISTINCT a.id AS source_node_id, b.id AS target_node_id, relation FROM parsed JOIN best a ON a.reference_code = source_ref JOIN best b ON b.reference_code = target_ref WHERE a.id <> b.id""")
def edge_resolve(spark, sf_dir):
    """Parsed edges to node ids, once each."""
    r = v.node_rows(spark, sf_dir)
    a = r.select(F.col("reference_code").alias("source_ref"), F.col("bare_code").alias("target_ref"), F.lit("IMPLEMENTS").alias("relation"))
    b = r.select(F.col("reference_code").alias("source_ref"), F.concat(F.lit("CS "), F.col("bare_code")).alias("target_ref"), F.lit("REQUIRES").alias("relation"))
    return g.resolve(a.unionByName(b).distinct(), v.nodes(spark, sf_dir, text=False)).distinct()


@query(f"""WITH {v.NODES}, t AS (SELECT reference_code AS source_ref, content_text || ' See CS ' || (20 + pos * 7 % 20) || '.' || (100 + pos % 13) || ' and ' || (20 + pos % 20) || '.' || (100 + pos % 7) || '(a).' AS x FROM nodes),
f AS (SELECT source_ref, code, COUNT(*) AS n FROM (SELECT source_ref, UNNEST(regexp_extract_all(x, '{CODE}')) AS code FROM t) GROUP BY ALL),
refs AS (SELECT DISTINCT reference_code AS ref FROM nodes WHERE node_type IN ('IR', 'CS')),
hit AS (SELECT f.source_ref, f.code, f.n, ARG_MIN(ref, rank) AS target_ref FROM f, (VALUES (0, ''), (1, 'CS ')) p(rank, prefix), refs WHERE refs.ref = p.prefix || f.code AND refs.ref <> f.source_ref GROUP BY ALL)
SELECT source_ref, target_ref, SUM(n)::BIGINT AS mentions FROM hit GROUP BY ALL""")
def crossref_edges(spark, sf_dir):
    """The article codes in every node's text that name a base article."""
    n = v.nodes(spark, sf_dir)
    code = lambda a, b: F.concat((20 + a % 20).cast("string"), F.lit("."), (100 + b).cast("string"))
    x = F.concat("content_text", F.lit(" See CS "), code(F.col("pos") * 7, F.col("pos") % 13), F.lit(" and "), code(F.col("pos"), F.col("pos") % 7), F.lit("(a)."))
    return g.cross_references(n.select(F.col("reference_code").alias("source_ref"), x.alias("content_text")), n.where("node_type IN ('IR', 'CS')").select(F.col("reference_code").alias("ref")), CODE)


@query(f"WITH {v.EDGES} SELECT source_node_id, target_node_id, COUNT(*) AS relations, MIN(relation) AS relation FROM edges GROUP BY ALL")
def edges_dedup(spark, sf_dir):
    """An edge once a pair."""
    return v.edges(spark, sf_dir).groupBy("source_node_id", "target_node_id").agg(F.count("*").alias("relations"), F.min("relation").alias("relation"))


@query(f"""WITH {v.NODES}, k AS (SELECT *, split_part(hierarchy_path, ' / ', 1) AS root FROM nodes)
SELECT a.node_id, b.node_id AS sibling_id, b.reference_code AS sibling_ref FROM k a JOIN k b ON a.bare_code = b.bare_code AND a.root = b.root AND a.node_id <> b.node_id""")
def siblings(spark, sf_dir):
    """The other nodes of every node's article and root. Nodes are one a type and reference, so an
    article has four at most and the pairs grow as the nodes do."""
    n = v.nodes(spark, sf_dir, text=False).select("node_id", "reference_code", article_code(F.col("reference_code")).alias("article"), F.split_part("hierarchy_path", F.lit(" / "), F.lit(1)).alias("root"))
    b = n.select(F.col("node_id").alias("sibling_id"), F.col("reference_code").alias("sibling_ref"), "article", "root")
    return n.join(b, ["article", "root"]).where("node_id <> sibling_id").select("node_id", "sibling_id", "sibling_ref")


@query(f"""WITH {v.NODES}, k AS (SELECT *, split_part(hierarchy_path, ' / ', 1) AS root FROM nodes)
SELECT root, bare_code AS article, node_id, reference_code, (ROW_NUMBER() OVER (PARTITION BY root, bare_code ORDER BY CASE node_type WHEN 'IR' THEN 0 WHEN 'CS' THEN 0 WHEN 'AMC' THEN 1 ELSE 2 END, reference_code, node_id))::INTEGER AS place, COUNT(*) OVER (PARTITION BY root, bare_code) AS members FROM k""")
def sibling_places(spark, sf_dir):
    """Every node's place among the nodes of its article and root."""
    n = v.nodes(spark, sf_dir, text=False).select("node_id", "node_type", "reference_code", article_code(F.col("reference_code")).alias("article"), F.split_part("hierarchy_path", F.lit(" / "), F.lit(1)).alias("root"))
    return g.memberships(n, ["root", "article"])


@query(f"""WITH {v.EDGES}, seen AS (SELECT node_id FROM nodes WHERE node_type NOT IN ('GM') AND source_doc_id <> 'src3')
SELECT source_node_id, target_node_id, relation FROM edges WHERE source_node_id IN (SELECT node_id FROM seen) AND target_node_id IN (SELECT node_id FROM seen)""")
def graph_visible(spark, sf_dir):
    """Edges seen with GM hidden and the group src3 collapsed."""
    n = v.nodes(spark, sf_dir, text=False)
    collapsed = n.where("source_doc_id = 'src3'").select(F.col("source_doc_id").alias("group_id"), "node_id")
    return g.visible(n, v.edges(spark, sf_dir), ["GM"], collapsed)[1]


@query(f"""WITH {v.EDGES}, few AS (SELECT node_id FROM nodes WHERE pos % 3 <> 0)
SELECT DISTINCT source_node_id, target_node_id, relation FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM few) OR target_node_id NOT IN (SELECT node_id FROM few)""")
def dangling_edges(spark, sf_dir):
    """Edges left without an end when some nodes go."""
    return g.dangling(v.edges(spark, sf_dir), v.nodes(spark, sf_dir, text=False).where("pos % 3 <> 0"))


@query(f"WITH {v.EDGES} SELECT (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(*) FROM edges) AS edges, (SELECT COUNT(DISTINCT relation) FROM edges) AS relations, (SELECT MAX(ts) FROM events) AS last_fetch")
def stats(spark, sf_dir):
    """A2: counts of the tables in one row."""
    one = lambda df, *a: df.agg(*a)
    e = v.edges(spark, sf_dir)
    return one(v.nodes(spark, sf_dir, text=False), F.count("*").alias("nodes")).join(one(e, F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))).join(one(v.read(spark, sf_dir, "events"), F.max("ts").alias("last_fetch")))


@query()
def relation_sizes(spark, sf_dir):
    """A2: files and bytes of every table."""
    return table_sizes({t: v.read(spark, sf_dir, t) for t in ("documents", "embeddings", "events", "pages", "conversations", "labels", "benchmark")})


@query(f"WITH {v.NODE_ROWS} SELECT node_type, reference_code, ARG_MIN(node_id, pos) AS node_id, MIN(pos) AS pos FROM node_rows GROUP BY 1, 2")
def dedup_first(spark, sf_dir):
    """A12."""
    return first_wins(v.node_rows(spark, sf_dir), ["node_type", "reference_code"], "pos").select("node_type", "reference_code", "node_id", "pos")


@query(f"WITH {v.NODE_ROWS} SELECT node_type, reference_code, ARG_MAX(node_id, pos) AS node_id, MAX(pos) AS pos, MIN(pos) AS first_pos FROM node_rows GROUP BY 1, 2")
def dedup_last(spark, sf_dir):
    """A13."""
    return last_wins(v.node_rows(spark, sf_dir), ["node_type", "reference_code"], "pos").select("node_type", "reference_code", "node_id", "pos", "first_pos")


@query(f"""WITH {v.NODE_ROWS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY reference_code ORDER BY pos) AS k FROM node_rows)
SELECT node_id, CASE WHEN k > 1 THEN reference_code || ' (' || k || ')' ELSE reference_code END AS unique_ref FROM k""")
def dedup_numbered(spark, sf_dir):
    """A14."""
    return numbered(v.node_rows(spark, sf_dir), "reference_code", "pos", "unique_ref").select("node_id", "unique_ref")
