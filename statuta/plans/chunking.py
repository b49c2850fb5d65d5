"""Embedding-ready chunks of nodes, made again only where a node's text or place has changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recursive_split
from ..functions.text import breadcrumb

#: Chunks in a request to the embedder.
BATCH = 32


def _head() -> Column:
    root = F.split_part("hierarchy_path", F.lit(" / "), F.lit(1))
    return breadcrumb(root, F.col("hierarchy_path"), F.col("reference_code"), F.col("title"))


def embeddable(nodes: DataFrame) -> DataFrame:
    """Nodes with text, but groups, with source_hash, of all that their chunks are made of."""
    n = nodes.where("node_type <> 'GROUP' AND content_text IS NOT NULL AND content_text <> ''")
    return n.withColumn("source_hash", F.md5(F.concat_ws("\u0001", _head(), "content_text")))


def chunks(nodes: DataFrame) -> DataFrame:
    """(chunk_id, parent_node_id, chunk_index, document, source_hash) of the nodes with text,
    each chunk under its breadcrumb; the id of the first chunk is the node's, of the others node__cN."""
    cut = embeddable(nodes).select("node_id", "source_hash", _head().alias("head"), recursive_split("content_text").alias("c"))
    out = cut.select("node_id", "source_hash", "head", F.posexplode("c").alias("chunk_index", "body"))
    name = F.when(F.col("chunk_index") == 0, F.col("node_id")).otherwise(F.concat(F.col("node_id"), F.lit("__c"), F.col("chunk_index")))
    return out.select(name.alias("chunk_id"), F.col("node_id").alias("parent_node_id"), "chunk_index", F.concat(F.col("head"), F.lit("\n\n"), F.col("body")).alias("document"), "source_hash")


def surplus(stored: DataFrame, fresh: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Stored chunks of re-chunked nodes that are no longer made. nodes: those that were re-chunked (node_id);
    without it the ones that have fresh chunks, which leaves out nodes whose text now makes none."""
    again = fresh.select("parent_node_id").distinct() if nodes is None else nodes.select(F.col("node_id").alias("parent_node_id"))
    return stored.join(again, "parent_node_id", "left_semi").join(fresh.select("chunk_id"), "chunk_id", "left_anti")


def changed_nodes(nodes: DataFrame, stored: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The embeddable nodes of whose present text and place there are no stored chunks. Texts are not
    shuffled beside the chunks: one row a node meets its digest. held: (node_id, source_hash) of the nodes that
    were chunked, where they are known; a text that makes no chunk is then not tried again."""
    if held is None:
        held = stored.groupBy(F.col("parent_node_id").alias("node_id"), "source_hash").agg(F.count("*").alias("_n"))
    ids = embeddable(nodes).select("node_id", "source_hash").join(held, ["node_id", "source_hash"], "left_anti")
    return nodes.join(ids.select("node_id"), "node_id", "left_semi")


def rechunked(nodes: DataFrame, stored: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks to make, chunk_ids to remove): chunks of changed nodes alone; stored chunks whose node
    is gone or no longer has text, and those beyond what a changed node now has, be it none."""
    changed = changed_nodes(nodes, stored, held)
    fresh = chunks(changed)
    alive = embeddable(nodes).select(F.col("node_id").alias("parent_node_id"))
    gone = stored.join(alive, "parent_node_id", "left_anti").select("chunk_id")
    return fresh, gone.unionByName(surplus(stored, fresh, changed).select("chunk_id")).distinct()


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """rows (with document) and the embedding of each, from an embedder that takes some documents at a
    time. Where a request fails its documents are tried one by one; what still fails is left out."""

    def one_by_one(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            try:
                out.append(embed([t])[0])
            except Exception:  # a text that the embedder refuses
                out.append(None)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: list[list[float] | None] = []
            for a in range(0, len(f), batch):
                texts = f["document"].iloc[a : a + batch].tolist()
                try:
                    found += embed(texts)
                except Exception:  # the request as a whole
                    found += one_by_one(texts)
            yield f.assign(embedding=found)[[x is not None for x in found]]

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", embedding array<float>")


def hashed_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic offline stand-in for an embedder: counts of hashed words."""
    from zlib import crc32

    out = []
    for t in texts:
        at = [0.0] * width
        for w in t.lower().split():
            at[crc32(w.encode()) % width] += 1.0
        out.append(at)
    return out
