"""Asking: codes, full text and vectors, fused; reranked; answered from context; sources deduplicated.

The parts backed by models have deterministic offline stand-ins: the caller gives the question's
vector, the reranker counts words, the answer is extractive. Candidate pools are bounded by their
definition, so the later steps work on a few rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import ASKED_CODE, base_ref
from ..operators import fulltext as ft
from ..operators import retrieval as r
from ..operators.dedup import keep_unseen


def named_documents(question: str) -> list[str]:
    """F17 of one question, on the driver: the ids of the documents that it names."""
    names = [re.sub(r"[\s-]", "", n).lower() for n in re.findall(r.DOC_NAME.removeprefix("(?i)"), question, re.IGNORECASE)]
    return list(dict.fromkeys(r.DOC_IDS[n] for n in names if n in r.DOC_IDS))


def cleaned(question: str) -> str:
    """F18 of one question, on the driver."""
    return " ".join(re.sub(r.STRIPPED.removeprefix("(?i)"), " ", question, flags=re.IGNORECASE).split()) or question


def ask(nodes: DataFrame, vectors: DataFrame, question: str, vector: list[float], sources: dict[str, list[str]], n: int = 6, text_limit: int = 8, index: DataFrame | None = None) -> DataFrame:
    """(place, node_id, reference_code, node_type, hierarchy_path, score, cited, answer).

    nodes: with source_doc_id; vectors: (node_id, vec_id, source_doc_id, embedding), stored; sources:
    the source_doc_ids of a document id; index: postings of the nodes, such as read_postings() of the
    question's terms, else made of the nodes that may be meant. A document that the question names
    restricts all that follows. 1 exact and pattern code hits at distance 0; 2 full-text hits of the
    cleaned question at 0.05, without those; 3 the nearest parents by vector, without both; 4
    reciprocal ranks, code hits first; 5 rerank of the pool with its threshold; 6 an answer from the
    context and its citations; 7 sources without repeats. The limits are the method's own: the
    ids of steps 1 to 3, at most n + text_limit + max(2 n, 20), are known before texts are fetched, once, for
    the pool alone.
    """
    codes, search = sorted(set(re.findall(ASKED_CODE, question))), cleaned(question)
    named = [s for d in named_documents(question) for s in sources.get(d, [])]
    within = F.col("source_doc_id").isin(named) if named else F.lit(True)
    inside = nodes.where(within)
    coded = inside.where(r.is_coded(codes)).orderBy("reference_code", "node_id").limit(n).select("node_id", F.lit(0.0).alias("distance"), F.lit(0).alias("stage"))
    first = [x["node_id"] for x in coded.collect()]
    words = ft.postings(inside, only=ft.asked_terms(search)) if index is None else index.join(inside.select("node_id"), "node_id", "left_semi") if named else index
    texts = ft.search(words, search).where(~F.col("node_id").isin(first)).orderBy(F.col("rank").desc(), "node_id").limit(text_limit)
    second = [x["node_id"] for x in texts.select("node_id").collect()]
    near = r.nearest_parents(vectors.where(within & ~F.col("node_id").isin([*first, *second])), vector, max(2 * n, 20))
    third = [(x["node_id"], x["distance"], 2) for x in near.select("node_id", "distance").collect()]
    known = [*((i, 0.0, 0) for i in first), *((i, 0.05, 1) for i in second), *third]
    item = [F.struct(F.lit(i).alias("node_id"), F.lit(d).cast("double").alias("distance"), F.lit(k).alias("stage")) for i, d, k in known]
    pool = nodes.sparkSession.range(1).select(F.inline(F.array(*item).cast("array<struct<node_id:string,distance:double,stage:int>>")))
    cols = ["node_id", "reference_code", "node_type", "hierarchy_path", "content_text"]
    # by their ids, which go down to where the texts are read
    every = nodes.select(*cols).where(F.col("node_id").isin([i for i, _, _ in known])).join(F.broadcast(pool), "node_id")
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("distance", "node_id")) - 1
    fused = every.withColumn("rrf", F.when(F.col("stage") == 0, F.lit(1.0)).otherwise(1.0 / (F.lit(float(r.RRF_K)) + rank)))
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("rrf").desc(), "stage", "node_id")
    pool = fused.withColumn("pos", F.row_number().over(one)).where(F.col("pos") <= max(2 * n, 12))
    wanted = [w for g in ft.parsed(search) for yes, o in g if yes for w, _ in o.terms]
    kept = r.rerank(pool, r.lexical_score(F.concat_ws(" ", "reference_code", "content_text"), wanted), top=max(n, r.RERANK_TOP))
    item = F.struct("place", "node_id", base_ref(F.col("reference_code")).alias("ref"), "node_type", "hierarchy_path", F.round(1 - F.col("distance"), 3).alias("score"), F.substring("content_text", 1, 200).alias("snippet"))
    row = kept.groupBy().agg(F.sort_array(F.collect_list(item)).alias("h"))
    row = row.select(keep_unseen(F.slice("h", 1, n), lambda x: x["node_id"], lambda x: x["ref"]).alias("s"))
    answer = F.array_join(F.transform(F.slice("s", 1, 2), lambda x: F.concat(F.lit("["), x["ref"], F.lit("] "), x["snippet"])), "\n\n")
    out = row.select(answer.alias("answer"), F.explode("s").alias("x"))
    return out.select("x.place", "x.node_id", F.col("x.ref").alias("reference_code"), "x.node_type", "x.hierarchy_path", "x.score", F.contains(F.lower("answer"), F.lower("x.ref")).alias("cited"), "answer")
