"""Catalogue entries and the documents that their patterns name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries without an anchor of which a block of the pattern table has about so many.
PATTERN_ROWS = 10_000


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower case; none of a shorter one."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.char_length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def like_grams(pattern: Column) -> Column:
    """Runs of three characters that every text must have which a LIKE pattern names: those of its
    parts between wildcards and escapes."""
    return F.array_distinct(F.flatten(F.transform(F.split(pattern, r"\\.|[%_]"), grams)))


def named_texts(entries: DataFrame, docs: DataFrame, pattern: str = "title_pat", text: str = "title") -> DataFrame:
    """(pattern, text), each pair once: the texts that a LIKE pattern names, whatever the case.

    Patterns are data. Equal patterns and equal texts are tried once. A pattern gets an anchor: of the
    runs of three characters that it asks for the one in the fewest texts. Texts meet the patterns of
    their own runs by an equi-join, and are then tried; a pattern meets a text once. Patterns without
    three characters in a row are tried against every text, in blocks that are broadcast. Null patterns
    and texts name nothing.
    """
    asked = entries.select(F.col(pattern).alias("_pattern")).where("_pattern IS NOT NULL").distinct().withColumn("_grams", like_grams(F.col("_pattern")))
    texts = docs.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    tried = F.ilike(F.col("_text"), F.col("_pattern"))
    runs = texts.select("_text", F.explode(grams(F.col("_text"))).alias("_gram"))
    wants = asked.select("_pattern", F.explode("_grams").alias("_gram"))
    known = runs.join(wants.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_texts"))
    anchor = wants.join(known, "_gram", "left").groupBy("_pattern").agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), F.col("_gram"))).alias("_gram"))
    out = runs.join(anchor, "_gram").where(tried).select("_pattern", "_text")
    loose = asked.where(F.size("_grams") == 0).select("_pattern")
    blocks = -(-loose.count() // PATTERN_ROWS)
    for k in range(blocks):
        part = loose.where(F.pmod(F.xxhash64("_pattern"), F.lit(blocks)) == k)
        out = out.unionByName(texts.join(F.broadcast(part), tried).select("_pattern", "_text"))
    return out.select(F.col("_pattern").alias(pattern), F.col("_text").alias(text))


def pattern_join(entries: DataFrame, docs: DataFrame, pattern: str = "title_pat", text: str = "title") -> DataFrame:
    """named_texts() as rows: every document beside every entry (id, ...) whose pattern names its text."""
    return docs.join(named_texts(entries, docs, pattern, text), text).join(entries, pattern).select(*docs.columns, *entries.columns)


def pattern_groups(entries: DataFrame, docs: DataFrame, first: Callable[[], list[Column]], again: Callable[[], list[Column]], pattern: str = "title_pat", text: str = "title") -> DataFrame:
    """Per entry (id, pattern) the documents that it names, gathered by first() within equal texts, then by again()
    over the texts of its pattern and over entries of one id, without a row for every document of
    every entry. An entry that names nothing has no row."""
    per_text = docs.groupBy(text).agg(*first())
    per = per_text.join(named_texts(entries, docs, pattern, text), text).groupBy(pattern).agg(*again())
    return entries.select("id", pattern).join(per, pattern).groupBy("id").agg(*again())


def entry_counts(entries: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per entry the number of nodes that its patterns reach and their most frequent
    root (ties to the smaller). entries: (id, title_pat, ref_pat); docs: (doc_id, title); nodes:
    (doc_id, reference_code, root). Titles come first: a node is tried only against the patterns of
    entries that name its document."""
    hit = pattern_join(entries, docs).select("id", "ref_pat", "doc_id")
    asked = hit.select("doc_id", "ref_pat").distinct()
    by_root = nodes.join(asked, "doc_id").where("ref_pat IS NULL OR reference_code RLIKE ref_pat").groupBy("doc_id", "ref_pat", "root").agg(F.count("*").alias("n"))
    per = hit.join(by_root, (hit["doc_id"] == by_root["doc_id"]) & hit["ref_pat"].eqNullSafe(by_root["ref_pat"])).groupBy("id", "root").agg(F.sum("n").alias("n"))
    agg = per.groupBy("id").agg(F.sum("n").alias("node_count"), F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("root"))
    return entries.select("id").join(agg, "id", "left").select("id", F.coalesce("node_count", F.lit(0)).alias("node_count"), "root")


def mode_root(nodes: DataFrame) -> DataFrame:
    """A5: per document its node count and most frequent root, ties to the smaller."""
    per = nodes.groupBy("doc_id", "root").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("node_count"), F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("root"))


def best_documents(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the documents that an entry's title pattern names the one with most nodes."""
    best = lambda: [F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id"))).alias("doc_id"), F.max("n").alias("n")]
    return pattern_groups(entries, docs, best, best).withColumnRenamed("n", "node_count")

# Categories in the order in which they are shown.
CATEGORIES = ("basic", "ir", "cs", "amcgm", "other")


def category_order(category: Column) -> list[Column]:
    """Sort keys of categories: the known ones in their order, then the others by name."""
    at = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category)
    return [at == 0, at, category]


def with_checks(entries: DataFrame, checks: DataFrame) -> DataFrame:
    """Entries and what the version check of their source_root found, if there was one; a
    root's last check counts (checked_at)."""
    last = checks.groupBy("source_root").agg(F.max_by(F.struct("latest_version", "outdated"), "checked_at").alias("_c"))
    return entries.join(last, "source_root", "left").select(*entries.columns, "_c.latest_version", F.coalesce("_c.outdated", F.lit(False)).alias("outdated"))
