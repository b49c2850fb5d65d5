"""Upkeep of sources, groups and the catalogue; links in texts; labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.references import CODE, article_code
from .graph import type_rank


def groups(nodes: DataFrame) -> DataFrame:
    """One GROUP node a subpart, found by its name in the path; the id follows from the name,
    so reruns agree."""
    sub = subpart(F.col("hierarchy_path"))
    g = nodes.select(F.split_part("hierarchy_path", F.lit(" / "), F.lit(1)).alias("root"), sub.alias("subpart")).where("subpart IS NOT NULL").dropDuplicates(["root", "subpart"])
    return g.select(F.md5(F.concat_ws("\u0001", F.lit("GROUP"), "root", "subpart")).alias("group_id"), "root", "subpart")


def subpart(path: Column) -> Column:
    """The first segment of a path that begins with SUBPART."""
    return F.get(F.filter(F.split(path, " / "), lambda s: s.rlike("^SUBPART")), F.lit(0))


def contains_edges(group: DataFrame, nodes: DataFrame) -> DataFrame:
    """Group to node. The prefix condition is an equality of the extracted subpart, so the join
    hashes instead of looping."""
    n = nodes.select("node_id", F.split_part("hierarchy_path", F.lit(" / "), F.lit(1)).alias("root"), subpart(F.col("hierarchy_path")).alias("subpart"))
    return group.join(n, ["root", "subpart"]).select(F.col("group_id").alias("source_node_id"), F.col("node_id").alias("target_node_id"), F.lit("CONTAINS").alias("relation"))


def links(texts: DataFrame, nodes: DataFrame, pattern: str = CODE) -> DataFrame:
    """(node_id, token, target_ref): tokens of a text that are a reference, or else the
    bare code of one; of those with one code the base article counts, then AMC, then GM."""
    rank = type_rank(F.col("node_type"))
    exact = nodes.groupBy("reference_code").agg(F.min("reference_code").alias("r")).select(F.col("reference_code").alias("token"), F.col("r").alias("exact_ref"))
    bare = nodes.groupBy(article_code(F.col("reference_code")).alias("token")).agg(F.min_by("reference_code", F.struct(rank, F.col("reference_code"))).alias("bare_ref"))
    t = texts.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("content_text", F.lit(f"({pattern})"), F.lit(1)))).alias("token"))
    j = t.join(exact, "token", "left").join(bare, "token", "left")
    return j.select("node_id", "token", F.coalesce("exact_ref", "bare_ref").alias("target_ref")).where("target_ref IS NOT NULL")


def section_refs(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends like ``§ 4.3`` of relations to the reference with that section code; ends that name
    no section stay; relations with an end that is not found go."""
    code = lambda c: F.nullif(F.regexp_extract(c, r"§\s*([0-9.]+)", 1), F.lit(""))
    by = nodes.select(code(F.col("reference_code")).alias("code"), F.col("reference_code").alias("ref")).where("code IS NOT NULL").groupBy("code").agg(F.min("ref").alias("ref"))
    out = relations
    for end in ("source_ref", "target_ref"):
        side = by.select(F.col("code").alias(f"_{end}"), F.col("ref").alias(f"_r_{end}"))
        out = out.withColumn(f"_{end}", code(F.col(end))).join(side, f"_{end}", "left").withColumn(end, F.when(F.col(f"_{end}").isNull(), F.col(end)).otherwise(F.col(f"_r_{end}"))).drop(f"_{end}", f"_r_{end}")
    return out.where("source_ref IS NOT NULL AND target_ref IS NOT NULL").distinct()


def fill_pattern(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """K8: entries whose title pattern is null get ``%title[:60]%`` of their harvested document."""
    j = entries.join(titles.select("harvest_key", "title"), "harvest_key", "left")
    return j.withColumn("doc_title_pattern", F.coalesce("doc_title_pattern", F.when(F.col("title").isNotNull(), F.concat(F.lit("%"), F.substring("title", 1, 60), F.lit("%"))))).drop("title")


def patched(table: DataFrame, key: str, value, changes: dict, allowed: tuple[str, ...]) -> DataFrame:
    """One row's columns replaced; columns outside the allow-list are refused."""
    wrong = sorted(set(changes) - set(allowed))
    if wrong:
        raise ValueError(f"not changeable: {wrong}")
    here = F.col(key) == F.lit(value)
    return table.withColumns({c: F.when(here, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def without_source(sources: DataFrame, documents: DataFrame, source_id) -> DataFrame:
    """The sources without one; refused while documents of it exist."""
    if not documents.where(F.col("source_id") == F.lit(source_id)).isEmpty():
        raise ValueError("the source has documents")
    return sources.where(F.col("source_id") != F.lit(source_id))


def purged(tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(table, rows) before, and the tables emptied."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts, {name: df.limit(0) for name, df in tables.items()}


def split_flags(urls: Column, flags: tuple[str, ...] = ("use_smart_parser", "use_narrative_parser")) -> tuple[Column, Column]:
    """(the map without flags, whether the first flag is set)."""
    keep = F.map_filter(urls, lambda k, _: ~k.isin(list(flags)))
    return keep, F.coalesce(F.lower(F.try_element_at(urls, F.lit(flags[0]))) == "true", F.lit(False))


def short_label(ref: Column) -> Column:
    """``App X`` and ``SP X``, and nothing after a dash."""
    s = F.regexp_replace(F.regexp_replace(ref, r"(?i)^appendix\s+", "App "), r"(?i)^subpart\s+", "SP ")
    return F.trim(F.regexp_replace(s, r"\s+[—–]\s.*$", ""))


def allowed(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is in a closed list, as the enumerations of the tables ask."""
    return df.where(F.col(column).isin(list(values)))


def placed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that have a path."""
    return nodes.where(F.coalesce(F.col("hierarchy_path"), F.lit("")) != "")


def enabled_sources(sources: DataFrame) -> DataFrame:
    """The sources to harvest (external_id, name, urls, smart, narrative) of (external_id, name, urls
    map, enabled): flags kept among the urls become columns, the first true where it is not given."""
    urls, _ = split_flags(F.coalesce(F.col("urls"), F.create_map().cast("map<string,string>")))
    flag = lambda name, usual: F.coalesce(F.lower(F.try_element_at("urls", F.lit(name))) == "true", F.lit(usual))
    return sources.where("enabled").select("external_id", "name", urls.alias("urls"), flag("use_smart_parser", True).alias("smart"), flag("use_narrative_parser", False).alias("narrative"))


def created(catalog: DataFrame, entry: dict, required: tuple[str, ...] = ("id", "name", "short", "category_id", "domain_id")) -> DataFrame:
    """The catalogue with a new active entry at its end. A missing field and an id that exists are
    refused; empty keys and patterns become null, other absent texts empty."""
    missing = sorted(set(required) - set(entry))
    if missing:
        raise ValueError(f"missing: {missing}")
    if not catalog.where(F.col("id") == F.lit(entry["id"])).isEmpty():
        raise ValueError(f"exists: {entry['id']}")
    filled = {"description": "", "easa_url": ""} | entry | {k: entry.get(k) or None for k in ("harvest_key", "doc_title_pattern")} | {"is_active": True}
    row = catalog.agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).alias("sort_order"))
    types = {f.name: f.dataType for f in catalog.schema.fields}
    row = row.select(*[F.col(c).cast(t).alias(c) if c == "sort_order" else F.lit(filled.get(c)).cast(t).alias(c) for c, t in types.items()])
    return catalog.unionByName(row)
