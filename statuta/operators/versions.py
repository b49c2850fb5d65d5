"""Change detection between versions, histories and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diff import word_diff


def changes(old: DataFrame, new: DataFrame, key: str = "reference_code", digest: str = "content_hash") -> DataFrame:
    """(key, change_type) for every key of either side: added, modified, deleted,
    unchanged. One full outer join on the key; texts stay behind."""
    a = old.select(key, F.col(digest).alias("old_hash"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(digest).alias("new_hash"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type"), "old_hash", "new_hash")


def counters(changed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many of each kind, and in all."""
    kinds = ("added", "modified", "unchanged", "deleted")
    return changed.groupBy(*(by or [])).agg(*[F.count_if(F.col("change_type") == k).alias(f"nodes_{k}") for k in kinds], F.count("*").alias("nodes_total"))


def history_diffs(versions: DataFrame, key: list[str], order: str, text: str = "content_text", most: int | None = None) -> DataFrame:
    """Versions with diff, the words that changed since the version before it of the same key; the
    first one is inserted whole. One key's versions meet in one task, two texts at a time."""
    before = F.lag(text).over(Window.partitionBy(*key).orderBy(order))
    return versions.withColumn("_before", before).withColumn("diff", word_diff("_before", text, most)).drop("_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """The table after new rows replace old ones of their key.

    keep_old: columns that an existing row keeps (created_at). fill: columns where a null of the
    new row leaves the old value. Both sides have one row a key and the same columns. The
    result goes to a fresh path, as the tables are not transactional.
    """
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    b = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_new"))
    j = a.join(b, keys, "full_outer")

    def value(c: str) -> Column:
        was, now, here = F.col(f"_old.{c}"), F.col(f"_new.{c}"), F.col("_new").isNotNull()
        if c in keep_old:
            return F.when(F.col("_old").isNotNull(), was).otherwise(now)
        if c in fill:
            return F.coalesce(now, was)
        return F.when(here, now).otherwise(was)

    return j.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K6: old rows, and the new ones of keys that old has not (conflict: do nothing)."""
    rest = [c for c in old.columns if c not in keys]
    if not rest:
        one = new.select(*keys).distinct()
    else:  # of rows with one key the smallest, so that reruns agree
        one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def stale(stored: DataFrame, batch: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """K4: stored rows of the batch's documents whose key the batch has not."""
    touched = batch.select(doc).distinct()
    return stored.join(touched, doc, "left_semi").join(batch.select(doc, *keys).distinct(), [doc, *keys], "left_anti")


def indexed_rule(editions: DataFrame, key: str = "source_key") -> DataFrame:
    """an XML edition is indexed; a PDF one if its source has no XML and it is the latest."""
    xml = editions.groupBy(key).agg(F.max(F.col("doc_type") == "xml").alias("has_xml"))
    return editions.join(xml, key).withColumn("is_indexed", F.when(F.col("doc_type") == "xml", True).otherwise(~F.col("has_xml") & F.col("is_latest_pdf")))


def with_twin(editions: DataFrame) -> DataFrame:
    """XML editions with the PDF of their source and label; PDFs that are no twin stay alone."""
    x = editions.where("doc_type = 'xml'").select("source_key", "version_label", F.col("url").alias("xml_url"))
    p = editions.where("doc_type = 'pdf'").select("source_key", "version_label", F.col("url").alias("pdf_url"))
    return x.join(p, ["source_key", "version_label"], "full_outer")
