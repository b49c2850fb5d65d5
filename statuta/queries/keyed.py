"""Keyed writes with their rules of conflict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed
from ..sinks import shared_folder
from ..sinks.manifest import Runs
from ..sources import views as v
from . import query


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_custkey % 5 <> 0 AS was, c_custkey % 7 <> 0 AS now, c_custkey % 3 <> 0 AS has_id, c_custkey % 4 <> 0 AS by_id FROM customer),
old AS (SELECT k, 's' || k AS source_id, CASE WHEN has_id THEN 'e' || k END AS external_id, 'n' || k AS name, c_name AS base_url, k % 2 = 0 AS enabled, 1 AS last_sync_at, by_id, now, has_id, seg FROM c WHERE was)
SELECT source_id, external_id, CASE WHEN now AND by_id AND has_id THEN 'm' || k ELSE name END AS name, CASE WHEN now AND (NOT by_id OR has_id) THEN seg ELSE base_url END AS base_url, enabled, CASE WHEN now AND (NOT by_id OR has_id) THEN 2 ELSE 1 END AS last_sync_at FROM old
UNION ALL SELECT md5(CASE WHEN by_id THEN 'x:e' || k ELSE 'n:n' || k END), CASE WHEN by_id THEN 'e' || k END, CASE WHEN by_id THEN 'm' || k ELSE 'n' || k END, seg, TRUE, 2 FROM c WHERE now AND (NOT was OR (by_id AND NOT has_id))""")
def upsert_sources(spark, sf_dir):
    """K1: by external id, else by name; every row comes twice, the later one counts."""
    c, k = v.read(spark, sf_dir, "customer"), F.col("c_custkey")
    s = lambda x: F.concat(F.lit(x), k)
    same = [F.lit("xml").alias("format"), F.lit("weekly").alias("frequency")]
    old = c.where(k % 5 != 0).select(s("s").alias("source_id"), F.when(k % 3 != 0, s("e")).alias("external_id"), s("n").alias("name"), F.col("c_name").alias("base_url"), *same, (k % 2 == 0).alias("enabled"), F.lit(1).alias("last_sync_at"))
    rows = c.where(k % 7 != 0).select(F.when(k % 4 != 0, s("e")).alias("external_id"), F.when(k % 4 != 0, s("m")).otherwise(s("n")).alias("name"), F.explode(F.array(F.lit(""), F.col("c_mktsegment"))).alias("base_url"), *same)
    rows = rows.withColumn("pos", (F.col("base_url") != "").cast("int"))
    return keyed.upsert_sources(old, rows, F.lit(2)).drop("format", "frequency")


_DOCS = """
o AS (SELECT 'src' || (o_custkey % 25) AS source_id, 'x' || (o_orderkey % 60) AS external_id, o_orderkey AS k, o_orderstatus AS title, o_orderkey % 5 = 0 AS is_latest FROM orders),
a AS (SELECT source_id, external_id, ARG_MIN('d' || k, k) AS doc_id, ARG_MIN(title, k) AS title, ARG_MIN(is_latest, k) AS is_latest FROM o WHERE k % 3 <> 0 GROUP BY ALL),
b AS (SELECT source_id, external_id, ARG_MAX(title, k) AS title, ARG_MAX(is_latest, k) AS is_latest FROM o WHERE k % 2 = 0 GROUP BY ALL)"""


@query(f"""WITH {_DOCS} SELECT COALESCE(a.source_id, b.source_id) AS source_id, COALESCE(a.external_id, b.external_id) AS external_id, COALESCE(a.doc_id, md5(b.source_id || chr(1) || b.external_id)) AS doc_id,
CASE WHEN b.source_id IS NULL THEN a.title ELSE b.title END AS title, CASE WHEN b.source_id IS NULL THEN a.is_latest ELSE b.is_latest END AS is_latest FROM a FULL JOIN b ON a.source_id = b.source_id AND a.external_id = b.external_id""")
def upsert_documents(spark, sf_dir):
    """K2: by source and external id, written as a run and read through its manifest."""
    k = F.col("o_orderkey")
    o = v.read(spark, sf_dir, "orders").select(F.concat(F.lit("src"), F.col("o_custkey") % 25).alias("source_id"), F.concat(F.lit("x"), k % 60).alias("external_id"), k.alias("pos"), F.col("o_orderstatus").alias("title"), (k % 5 == 0).alias("is_latest"))
    first = keyed.last_of(o.where("pos % 3 <> 0").withColumns({"doc_id": F.concat(F.lit("d"), "pos"), "pos": -F.col("pos")}), ["source_id", "external_id"], "pos")
    runs = Runs(spark, shared_folder(spark, "documents"))
    runs.write({"documents": first})
    runs.write({"documents": lambda r: keyed.upsert_documents(r.table("documents"), o.where("pos % 2 = 0"))})
    return runs.table("documents")


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT 'n' || vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN label % 2 = 0 THEN 'p' || label ELSE 'n' || vec_id END ELSE 'p' || label END AS parent_node_id, CASE WHEN vec_id % 3 = 0 THEN y ELSE x END AS value FROM e WHERE vec_id % 4 <> 0 OR vec_id % 3 = 0""")
def upsert_chunks(spark, sf_dir):
    """K9: by chunk id; a new chunk without a parent is its own."""
    e, k = v.read(spark, sf_dir, "embeddings"), F.col("vec_id")
    name, parent = F.concat(F.lit("n"), k).alias("chunk_id"), F.concat(F.lit("p"), "label")
    old = e.where(k % 4 != 0).select(name, parent.alias("parent_node_id"), F.col("embedding")[0].cast("double").alias("value"))
    new = e.where(k % 3 == 0).select(name, F.when(F.col("label") % 2 == 0, parent).alias("parent_node_id"), F.col("embedding")[1].cast("double").alias("value"), k.alias("pos"))
    return keyed.upsert_chunks(old, new)


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand FROM part)
SELECT 'e' || k AS id, CASE WHEN k % 3 <> 0 THEN p_name ELSE p_brand END AS name, CASE WHEN k % 3 <> 0 THEN CASE k % 4 WHEN 0 THEN 'src-zero' WHEN 1 THEN 'one' END ELSE 'old' END AS harvest_key, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 ELSE TRUE END AS is_active,
CASE WHEN k % 3 <> 0 THEN k ELSE -k END AS sort_order FROM p WHERE k % 5 <> 0 OR k % 3 <> 0""")
def seed_catalog(spark, sf_dir):
    """Entries by id, which keep whether they are active."""
    p, k = v.read(spark, sf_dir, "part"), F.col("p_partkey")
    i = F.concat(F.lit("e"), k).alias("id")
    old = p.where(k % 5 != 0).select(i, F.col("p_brand").alias("name"), F.lit("old").alias("harvest_key"), (k % 2 == 0).alias("is_active"), (-k).alias("sort_order"))
    seed = p.where(k % 3 != 0).select(i, F.col("p_name").alias("name"), F.when(k % 4 == 0, "zero").when(k % 4 == 1, "one").alias("harvest_key"), k.alias("sort_order"))
    return keyed.seed_entries(old, seed, {"zero": "src-zero"})
