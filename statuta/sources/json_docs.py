"""The intermediate JSON form of a document: nodes and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "title string, version string, nodes array<struct<type:string,ref:string,title:string,hierarchy:string,text:string,html:string,source:string>>, relations array<struct<`from`:string,`to`:string,label:string,confidence:double>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def node_rows(docs: DataFrame) -> DataFrame:
    """One row a node; the hash is the first 16 hex digits of SHA-256."""
    n = docs.select("title", F.posexplode("nodes").alias("pos", "n"))
    return n.select(F.col("title").alias("doc_title"), "pos", F.coalesce(F.col("n.type"), F.lit("IR")).alias("node_type"), F.col("n.ref").alias("reference_code"), F.col("n.title").alias("title"), F.col("n.hierarchy").alias("hierarchy_path"), F.col("n.text").alias("content_text"), F.substring(F.sha2(F.coalesce("n.text", F.lit("")), 256), 1, 16).alias("content_hash"))


def relation_rows(docs: DataFrame) -> DataFrame:
    """One row a relation that has both ends: label in capitals with underscores, confidence 0.8
    where none is given."""
    r = docs.select("title", F.explode("relations").alias("r"))
    label = F.regexp_replace(F.upper("r.label"), " ", "_")
    return r.where(F.col("r.from").isNotNull() & F.col("r.to").isNotNull() & (F.col("r.from") != "") & (F.col("r.to") != "")).select(F.col("title").alias("doc_title"), F.col("r.from").alias("source_ref"), F.col("r.to").alias("target_ref"), label.alias("relation"), F.coalesce("r.confidence", F.lit(0.8)).alias("confidence"), F.lit("llm-extracted").alias("notes"))


def documents(nodes: DataFrame, relations: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """(title, version, nodes, relations), a row a document in the intermediate form.

    nodes: with source_doc_id, and ``order`` for their place in it; version_label where there is one.
    relations: (source_doc_id, source_ref, target_ref, relation, confidence), by their ends; a
    document without any has an empty array. The form has a document's nodes in one object, so
    source_doc_id must name a document and not a collection.
    """
    has = lambda c: c in nodes.columns
    value = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    node = F.struct(
        F.col("node_type").alias("type"), F.col("reference_code").alias("ref"), F.col("title"), F.col("hierarchy_path").alias("hierarchy"), F.col("content_text").alias("text"),
        value("content_html").alias("html"), value("regulatory_source").alias("source"),
    )
    held = nodes.select(F.col("source_doc_id").alias("doc"), value("version_label").alias("version"), F.struct((F.col(order) if has(order) else F.col("reference_code")).alias("at"), node.alias("n")).alias("x"))
    out = held.groupBy("doc").agg(F.max("version").alias("version"), F.transform(F.sort_array(F.collect_list("x")), lambda x: x["n"]).alias("nodes"))
    empty = F.array().cast("array<struct<`from`:string,`to`:string,label:string,confidence:double>>")
    if relations is None:
        return out.select(F.col("doc").alias("title"), "version", "nodes", empty.alias("relations"))
    said = F.struct(F.col("source_ref").alias("from"), F.col("target_ref").alias("to"), F.col("relation").alias("label"), F.col("confidence").cast("double").alias("confidence"))
    ends = relations.groupBy(F.col("source_doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(said)).alias("relations"))
    joined = out.join(ends, F.col("doc").eqNullSafe(F.col("_doc")), "left")
    return joined.select(F.col("doc").alias("title"), "version", "nodes", F.coalesce("relations", empty).alias("relations"))


def write(nodes: DataFrame, path: str, relations: DataFrame | None = None, order: str = "pos") -> None:
    """documents() as JSON lines."""
    documents(nodes, relations, order).write.mode("overwrite").json(path)
