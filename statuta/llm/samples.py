"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's text, modulo ``of``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % of


#: Bytes of text that a sample may hold; whole texts, taken in the sample's order while they fit.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, most: dict[int, int], held: tuple[int, int]) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """([(text, label)], {label: ids there are}): of each label at most ``most[label]`` ids, those
    with the smallest md5, none with remainder(id, held[0]) == held[1].

    Of an id's labels the largest counts, of its texts the smallest; null texts count as empty.
    The sample's bounds, ids and SAMPLE_BYTES, are its documented parameters; the counts are over
    all labelled ids.
    """
    rows = labels.where("doc_id is not null").select("doc_id", label.cast("int").alias("y")).where(F.col("y").isNotNull() & (remainder(F.col("doc_id"), held[0]) != held[1]))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect() if r["y"] in most}
    chosen = None
    for y in sorted(most):
        part = rows.where(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sum(most) ids: a bounded broadcast, and a bounded table after the aggregation
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    before = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = texts.withColumn("held", F.sum(F.octet_length("text")).over(before)).where(F.col("held") <= SAMPLE_BYTES)
    got = fits.select("doc_id", "text", "y").collect()
    got.sort(key=lambda r: r["doc_id"])
    return [(r["text"], r["y"]) for r in got], counts
