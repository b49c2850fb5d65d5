"""The domain's tables as deterministic views of the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed nodes in document order; (node_type, reference_code) repeats."""
    d = read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "CS").when(F.col("lang") == "fr", "IR").when(F.col("lang") == "de", "AMC").otherwise("GM")
    bare = F.concat((20 + F.substring("source", 4, 9).cast("int")).cast("string"), F.lit("."), (F.expr("doc_id div 80") + 100).cast("string"))
    return d.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("n"), F.col("doc_id")).alias("node_id"),
        kind.alias("node_type"),
        F.when(kind == "IR", bare).otherwise(F.concat(kind, F.lit(" "), bare)).alias("reference_code"),
        bare.alias("bare_code"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("content_text"),
        F.concat(F.lit("Corpus "), F.col("source"), F.lit(" / SUBPART "), F.upper("lang"), F.lit(" / Band "), F.expr("n_chars div 1000").cast("string")).alias("hierarchy_path"),
        F.col("source").alias("source_doc_id"),
    )


#: SQL of node_rows(), to put before an oracle's own text.
NODE_ROWS = """
node_rows AS (
  SELECT doc_id AS pos, 'n' || doc_id AS node_id, kind AS node_type,
         CASE WHEN kind = 'IR' THEN bare ELSE kind || ' ' || bare END AS reference_code, bare AS bare_code,
         substring(text, 1, 40) AS title, text AS content_text,
         'Corpus ' || source || ' / SUBPART ' || upper(lang) || ' / Band ' || (n_chars // 1000) AS hierarchy_path, source AS source_doc_id
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'CS' WHEN 'fr' THEN 'IR' WHEN 'de' THEN 'AMC' ELSE 'GM' END AS kind,
               (20 + substring(source, 4, 9)::INTEGER) || '.' || (doc_id // 80 + 100) AS bare FROM documents))"""

#: SQL of the nodes that first-wins deduplication leaves.
NODES = NODE_ROWS + """,
nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node_type, reference_code ORDER BY pos) AS rn FROM node_rows) WHERE rn = 1)"""


def nodes(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Stored nodes: one a (node_type, reference_code), the first in document order. Without text
    the bodies are neither read nor shuffled."""
    from ..operators.dedup import first_wins

    rows = node_rows(spark, sf_dir)
    if text:
        return first_wins(rows, ["node_type", "reference_code"], "pos")
    return first_wins(rows.drop("content_text", "title"), ["node_type", "reference_code"], "pos")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_node_id, target_node_id, relation): AMC and GM to their base articles, and each
    node to the one twenty places before it."""
    from ..operators.graph import base_article_edges

    n = nodes(spark, sf_dir, text=False)
    typed = base_article_edges(n).select("source_node_id", "target_node_id", "relation")
    back = n.select("node_id", (F.col("pos") - 20).alias("at"))
    refs = back.join(n.select(F.col("pos").alias("at"), F.col("node_id").alias("target_node_id")), "at")
    return typed.unionByName(refs.select(F.col("node_id").alias("source_node_id"), "target_node_id", F.lit("REFERENCES").alias("relation")))


EDGES = NODES + """,
bases AS (SELECT reference_code AS ref, MIN(node_id) AS base_id FROM nodes WHERE node_type IN ('IR', 'CS') GROUP BY reference_code),
typed AS (
  SELECT n.node_id AS source_node_id, n.reference_code AS source_ref, COALESCE(a.base_id, b.base_id) AS target_node_id, COALESCE(a.ref, b.ref) AS target_ref,
         CASE n.node_type WHEN 'AMC' THEN 'ACCEPTABLE_MEANS' ELSE 'GUIDANCE_FOR' END AS relation
  FROM nodes n LEFT JOIN bases a ON a.ref = n.bare_code LEFT JOIN bases b ON b.ref = 'CS ' || n.bare_code
  WHERE n.node_type IN ('AMC', 'GM') AND COALESCE(a.base_id, b.base_id) IS NOT NULL),
edges AS (
  SELECT source_node_id, target_node_id, relation FROM typed
  UNION ALL
  SELECT n.node_id, m.node_id, 'REFERENCES' FROM nodes n JOIN nodes m ON m.pos = n.pos - 20)"""


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the nodes: some keys missing on either side, some texts changed."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("REF."), F.col("doc_id")).alias("reference_code"), "doc_id", "source", "text")
    old = d.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Prior. "), F.col("text"))).otherwise(F.col("text")))
    shape = lambda x: x.select("reference_code", F.col("source").alias("doc_key"), F.col("text").alias("content_text"), F.md5("text").alias("content_hash"))
    return shape(old), shape(d.where("doc_id % 10 <> 5"))


OLD_NEW = """
old_nodes AS (SELECT 'REF.' || doc_id AS reference_code, source AS doc_key, CASE WHEN doc_id % 7 = 0 THEN 'Prior. ' || text ELSE text END AS content_text,
              md5(CASE WHEN doc_id % 7 = 0 THEN 'Prior. ' || text ELSE text END) AS content_hash FROM documents WHERE doc_id % 10 <> 3),
new_nodes AS (SELECT 'REF.' || doc_id AS reference_code, source AS doc_key, text AS content_text, md5(text) AS content_hash FROM documents WHERE doc_id % 10 <> 5)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvest runs: one a day and source of events; event types stand for change kinds."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("src"), F.col("user_id") % 20).alias("doc_key"), F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "click").alias("nodes_added"), F.count_if(F.col("event_type") == "view").alias("nodes_modified"), F.count("*").alias("nodes_total"), F.max("ts").alias("fetched_at")
    )


RUNS = """
runs AS (SELECT 'src' || (user_id % 20) AS doc_key, ts::DATE AS day, COUNT(*) FILTER (event_type = 'click') AS nodes_added,
         COUNT(*) FILTER (event_type = 'view') AS nodes_modified, COUNT(*) AS nodes_total, MAX(ts) AS fetched_at FROM events GROUP BY 1, 2)"""


def harvest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a source, with the number and the latest of its nodes."""
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    k = F.substring("source", 4, 9).cast("int")
    label = F.concat(F.element_at(F.array(F.lit("Amendment"), F.lit("Issue"), F.lit("Revision")), (k % 3 + 1).cast("int")), F.lit(" "), (k % 7).cast("string"))
    return d.select(F.col("source").alias("doc_id"), F.concat(F.lit("Easy Rules "), F.col("source")).alias("title"), label.alias("version_label"), (k % 4 != 3).alias("is_latest"), "n")


HARVEST_DOCS = """
harvest_docs AS (SELECT source AS doc_id, 'Easy Rules ' || source AS title, (['Amendment', 'Issue', 'Revision'])[(k % 3 + 1)] || ' ' || (k % 7) AS version_label, k % 4 <> 3 AS is_latest, n
  FROM (SELECT source, substring(source, 4, 9)::INTEGER AS k, COUNT(*) AS n FROM documents GROUP BY source))"""
