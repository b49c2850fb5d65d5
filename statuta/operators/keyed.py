"""Keyed writes of sources, documents, chunks and catalogue entries, each with its rule of conflict.

Every function returns the table after the write. Of several new rows that mean one stored row the
last one by ``order`` counts, so reruns agree; stored rows have one row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import upsert


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``; the order column goes. Keys may be null."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns if c != order])


def new_id(*parts: Column) -> Column:
    """An id that a key alone decides, so that a write that runs again makes the same."""
    return F.md5(F.concat_ws("\u0001", *parts))


def upsert_sources(stored: DataFrame, new: DataFrame, at: Column, order: str = "pos") -> DataFrame:
    """K1: sources after new rows (external_id, name, base_url, format, frequency, order).

    stored: (source_id, external_id, name, base_url, format, frequency, enabled, last_sync_at). A row with
    an external id means the stored row of that id, and renames it; where there is none it means
    the stored row of its name that has no external id, and gives it one. A row without an
    external id means the stored row of its name, whose id it leaves. What means no stored row is
    added, enabled. Rows with neither id nor name are left out.
    """
    new = new.where("external_id IS NOT NULL OR name IS NOT NULL")
    by_id = stored.where("external_id IS NOT NULL").select(F.col("external_id").alias("_x"), F.col("source_id").alias("_by_id"))
    by_name = stored.where("name IS NOT NULL").select(F.col("name").alias("_n"), F.col("source_id").alias("_by_name"), F.col("external_id").isNull().alias("_free"))
    met = new.join(by_id, new["external_id"] == by_id["_x"], "left").join(by_name, new["name"] == by_name["_n"], "left")
    named = F.when(F.col("external_id").isNull() | F.col("_free"), F.col("_by_name"))
    own = new_id(F.coalesce(F.concat(F.lit("x:"), "external_id"), F.concat(F.lit("n:"), "name")))
    met = met.withColumn("source_id", F.coalesce("_by_id", named, own)).drop("_x", "_n", "_by_id", "_by_name", "_free")
    fresh = last_of(met, ["source_id"], order).withColumns({"enabled": F.lit(True), "last_sync_at": at})
    old = stored.select("source_id", F.struct(*[c for c in stored.columns if c != "source_id"]).alias("o"))
    now = fresh.select("source_id", F.struct(*[c for c in stored.columns if c != "source_id"]).alias("n"))
    both = old.join(now, "source_id", "full_outer")
    renames = F.col("n.external_id").isNotNull()
    value = {
        "external_id": F.coalesce("n.external_id", "o.external_id"),
        "name": F.when(renames | F.col("o").isNull(), F.col("n.name")).otherwise(F.col("o.name")),
        "enabled": F.when(F.col("o").isNotNull(), F.col("o.enabled")).otherwise(F.col("n.enabled")),
    }
    pick = lambda c: value.get(c, F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return both.select(*["source_id" if c == "source_id" else pick(c).alias(c) for c in stored.columns])


def upsert_documents(stored: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """K2: documents after new rows of (source_id, external_id), which replace all but the doc_id."""
    keys = ["source_id", "external_id"]
    one = last_of(new, keys, order).withColumn("doc_id", new_id(*[F.col(k) for k in keys]))
    return upsert(stored, one.select(*stored.columns), keys, keep_old=("doc_id",))


def upsert_chunks(stored: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """K9: chunks after new rows of chunk_id, which replace all; a chunk without a parent is its own."""
    one = last_of(new, ["chunk_id"], order).withColumn("parent_node_id", F.coalesce("parent_node_id", "chunk_id"))
    return upsert(stored, one.select(*stored.columns), ["chunk_id"])


def seed_entries(stored: DataFrame, seed: DataFrame, sources: dict[str, str], order: str = "sort_order") -> DataFrame:
    """Catalogue entries after a seed of id: all is replaced but is_active, which a stored entry
    keeps and a new one has; harvest keys become the sources' ids where they are known."""
    known = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]) if sources else F.create_map().cast("map<string,string>")
    one = last_of(seed.withColumn("_order", F.col(order)), ["id"], "_order")
    one = one.withColumns({"harvest_key": F.coalesce(F.try_element_at(known, F.col("harvest_key")), F.col("harvest_key")), "is_active": F.lit(True)})
    return upsert(stored, one.select(*stored.columns), ["id"], keep_old=("is_active",))
