"""Writers: versioned tables, delimited text, JSON trees, one file a topic."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's name below spark.checkpoint.dir, which the driver and all executors share;
    a session of one machine that has not set it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="statuta-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_version(df: DataFrame, table: str, version: int) -> str:
    """A table's new state at a path of its own; readers move to it when it is whole."""
    path = f"{table.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def paragraph_rows(topics: DataFrame) -> DataFrame:
    """One row a paragraph with its topic's attributes."""
    p = topics.select("erules_id", "title", "type_of_content", "regulatory_source", "amended_by", F.posexplode(F.split("content_text", "\n")).alias("para", "text"))
    return p.where(F.trim("text") != "")


def write_paragraphs(topics: DataFrame, path: str) -> None:
    paragraph_rows(topics).write.mode("overwrite").csv(path, sep="#", header=True)


def write_by_topic(topics: DataFrame, path: str) -> None:
    """A folder a topic, each written by one task."""
    topics.repartition("erules_id").write.mode("overwrite").partitionBy("erules_id").json(path)


def tree_lines(topics: DataFrame) -> DataFrame:
    """(path, first, pos, line): documents (path) as nested JSON, a line a topic.

    A document's lines in the order of (first, pos) are one JSON text: its topics (pos, title,
    content_text) under their headings, headings in the order of their first topic. A line opens what
    begins at its topic and closes what ends there, so no row holds more than one topic, whatever the
    document's length. pos is unique in a document; a null heading is one of its own.
    """
    first = topics.groupBy("path", "heading").agg(F.min("pos").alias("first")).select(F.col("path").alias("_p"), F.col("heading").alias("_h"), "first")
    rows = topics.join(first, F.col("path").eqNullSafe(F.col("_p")) & F.col("heading").eqNullSafe(F.col("_h"))).drop("_p", "_h")
    w = Window.partitionBy("path").orderBy("first", "pos")
    rows = rows.select("path", "heading", "pos", "title", "content_text", "first", F.lag("first").over(w).alias("_before"), F.lead("first").over(w).alias("_after"))
    starts, ends = ~F.col("_before").eqNullSafe(F.col("first")), ~F.col("_after").eqNullSafe(F.col("first"))
    name = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    known = lambda c: F.when(F.col(c).isNull(), "null").otherwise(name(c))
    opened = F.concat(F.when(F.col("_before").isNull(), F.concat(F.lit('{"path":'), known("path"), F.lit(',"toc":['))).otherwise(""), F.when(starts, F.concat(F.lit('{"heading":'), known("heading"), F.lit(',"topics":['))).otherwise(""))
    topic = F.concat(F.lit('{"pos":'), F.col("pos").cast("string"), F.lit(',"title":'), known("title"), F.lit(',"content_text":'), known("content_text"), F.lit("}"))
    closed = F.when(F.col("_after").isNull(), "]}]}").when(ends, "]},").otherwise(",")
    return rows.select("path", "first", "pos", F.concat(opened, topic, closed).alias("line"))


def write_trees(topics: DataFrame, path: str, files: int = 1) -> None:
    """The JSON texts of all documents, sorted, in ``files`` text files or fewer: a document
    follows the other, and one that is cut between two files goes on in the next."""
    rows = tree_lines(topics)
    rows.repartitionByRange(files, "path", "first", "pos").sortWithinPartitions("path", "first", "pos").select("line").write.mode("overwrite").text(path)
