"""Harvesting: a parsed batch against the stored nodes, edges, snapshots and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diff import word_diff
from ..operators.dedup import first_wins
from ..operators.versions import changes, counters, insert_missing, stale, upsert

KEY = ["node_type", "reference_code"]


def ingest(stored: DataFrame, batch: DataFrame, version_label: str, pos: str = "pos") -> dict[str, DataFrame]:
    """K5, K7: one harvest run: new node table, version snapshots (content, and word diffs of what was
    modified; unchanged nodes have none), counters and deleted keys.

    stored and batch: (node_type, reference_code, source_doc_id, content_text, content_hash), the
    batch with its rows' positions, of which the first of a key counts. A key that another document
    holds is an old one; only nodes of the batch's own documents can be deleted. Texts are joined
    for changed keys alone.
    """
    batch = first_wins(batch, KEY, pos).drop(pos)
    key = lambda df: df.withColumn("k", F.concat_ws("\u0001", *KEY))
    gone = stale(stored, batch, "source_doc_id", KEY).join(batch.select(*KEY), KEY, "left_anti").select(*KEY, "content_text", "content_hash")
    old = stored.join(batch.select(*KEY), KEY, "left_semi").select(*KEY, "content_text", "content_hash").unionByName(gone)
    changed = changes(key(old), key(batch), "k")
    some = changed.where("change_type <> 'unchanged'").select("k", "change_type")
    was = key(old).select("k", F.col("content_text").alias("old_text"), F.col("content_hash").alias("old_hash"))
    now = key(batch).select("k", F.col("content_text").alias("new_text"), F.col("content_hash").alias("new_hash"))
    texts = some.join(was, "k", "left").join(now, "k", "left")
    diff = F.when(F.col("change_type") == "modified", word_diff("old_text", "new_text"))
    versions = texts.select("k", "change_type", F.lit(version_label).alias("version_label"), F.coalesce("new_text", "old_text").alias("content_text"), F.coalesce("new_hash", "old_hash").alias("content_hash"), diff.alias("diff_prev"))
    kept = stored.join(gone.select(*KEY), KEY, "left_anti")
    return {"nodes": upsert(kept, batch.select(*stored.columns), KEY), "versions": versions, "run": counters(changed), "deleted": gone.select(*KEY)}


def record(run: dict[str, DataFrame], table: str, number: int) -> None:
    """Appends a run's snapshots and counters to the stored tables, as partitions of the run's number;
    a run that is recorded again replaces its own."""
    for name in ("versions", "run"):
        run[name].write.mode("overwrite").parquet(f"{table.rstrip('/')}/{name}/run_no={number}")


def add_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that are not there yet, none from a node to itself."""
    return insert_missing(stored, new.where("source_node_id <> target_node_id"), ["source_node_id", "target_node_id", "relation"])
