"""The browsing tree: subpart, section, article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.references import article_code
from .graph import type_rank


def tree_rows(nodes: DataFrame) -> DataFrame:
    """Each node's subpart, section and article keys: upper case, single spaces (F32)."""
    parts = F.split("hierarchy_path", " / ")
    key = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    sub, sec = F.coalesce(F.get(parts, F.lit(1)), F.lit("Other")), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    return nodes.where("node_type <> 'GROUP'").select("*", F.get(parts, F.lit(0)).alias("root"), sub.alias("subpart"), key(sub).alias("subpart_key"), sec.alias("section"), key(sec).alias("section_key"), article_code(F.col("reference_code")).alias("article"))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Per root, subpart and section the nodes, articles, the least article number and
    the label, all-capitals forms first."""
    r = tree_rows(nodes)
    number = F.nullif(F.regexp_replace("article", "[^0-9]", ""), F.lit("")).try_cast("long")
    label = F.min_by("section", F.struct((F.col("section") != F.upper("section")).cast("int"), F.col("section")))
    return r.groupBy("root", "subpart_key", "section_key").agg(F.count("*").alias("nodes"), F.count_distinct("article").alias("articles"), F.coalesce(F.min(number), F.lit(0)).alias("min_article"), label.alias("section_label"))


def nested_tree(nodes: DataFrame) -> DataFrame:
    """One row an article: root, subpart, section, the keys that order it there, and
    its nodes as a sorted array. An article is the largest group gathered; whole documents are
    left as rows, which a page reads in the order of the keys."""
    r = tree_rows(nodes)
    item = F.struct(type_rank(F.col("node_type")).alias("rank"), F.col("reference_code").startswith("Appendix").alias("appendix"), "reference_code", "node_id", "node_type")
    num = F.coalesce(F.nullif(F.regexp_replace(F.element_at(F.split("article", r"\."), -1), "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0))
    return r.groupBy("root", "subpart_key", "section_key", "article").agg(F.sort_array(F.collect_list(item)).alias("nodes")).select("root", "subpart_key", "section_key", "article", (F.col("article") == "§Appendices").alias("last"), num.alias("number"), "nodes")


def subpart_rank(name):
    """Four sort keys of a subpart: GENERAL and Other last, numbered ones first by number."""
    num = F.nullif(F.regexp_extract(name, r"^(\d+)[\s.]", 1), F.lit("")).try_cast("int")
    trailing = F.when(F.upper(name) == "OTHER", 2).when(name.rlike(r"(?i)^GENERAL\b"), 1).otherwise(0)
    return F.struct(trailing.alias("trailing"), num.isNull().alias("unnumbered"), F.coalesce(num, F.lit(0)).alias("number"), name.alias("name"))
