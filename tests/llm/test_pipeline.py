"""The pipeline against its stages' models, stage by stage."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from statuta.llm import decontamination, mixing, ngram_join, quality_rules
from tests.llm.helpers import components as brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert outs[-1].columns == columns
            outs[-1] = outs[-1].persist()
    ids = [Counter(r["doc_id"] for r in o.select("doc_id").collect()) for o in outs]
    kept = {r["doc_id"] for r in quality_rules.judged(docs, ["doc_id"]).where("kept").collect()}
    assert set(ids[1]) == kept
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    roots = brute([(i, texts[i]) for i in kept], ngram_join.WIDTH, ngram_join.PERCENT)
    assert set(ids[2]) == {root for _, root in roots.values()}
    leaks = {r["doc_id"] for r in decontamination.hits(outs[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(ids[3]) == set(ids[2]) - leaks
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(outs[3]).collect()}
    assert ids[4] == Counter({i: n for i, n in plan.items() if n})
    assert ids[5] == ids[4]
    by = outs[5].groupBy("shard").agg(F.sum("doc_bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["b"] == r["s"] for r in by)


def test_run_is_the_stages(spark, sf_dir):
    a, b = (sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a and a == b
