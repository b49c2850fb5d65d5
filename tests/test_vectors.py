"""Lists of vectors: exact with all lists, recall with some, pruned files, awkward rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.catalog_of_queries import QUERIES
from statuta.operators import vector_lists as lists


def brute(rows, asked, n):
    ids = np.array([i for i, _ in rows])
    m = np.array([x for _, x in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(ids.tolist())}
    out = set()
    for i in asked:
        far = 1 - m @ m[at[i]]
        out |= {(i, int(ids[k])) for k in [k for k in np.lexsort((ids, far)) if ids[k] != i][:n]}
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_real_vectors(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 10)
    got = {(r["vec_id"], r["other_id"]) for r in QUERIES["knn_lists"](spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)
    truth = spark.createDataFrame(sorted(want), "vec_id long, other_id long")
    assert lists.recall(QUERIES["knn_lists"](spark, sf), truth) == len(got & want) / len(want)


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=8) * 0.3 + 3 * np.eye(8)[0 if k % 3 == 0 else k % 8]).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # one place holds a quarter of the rows
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def test_hot_list_in_parts_and_ties(spark, clouds):
    df, rows = clouds
    rows = [(i, np.float32(x)) for i, x in rows]
    centroids = lists.fit(df, lists=12)
    asked = df.where("vec_id % 20 = 0")
    got = lists.neighbours(df, asked, centroids, 5, probes=12, part_rows=30)
    assert {(r["vec_id"], r["other_id"]) for r in got.collect()} == brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert {r["place"] for r in got.collect()} == {1, 2, 3, 4, 5}


def test_measured_probes(spark, clouds):
    df, rows = clouds
    centroids = lists.fit(df, lists=12)
    few, most = (lists.enough_probes(df, centroids, 5, target=t, questions=40) for t in (0.5, 1.0))
    assert 1 <= few <= most <= 12
    asked = df.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(40).drop("h")
    truth = lists.neighbours(df, asked, centroids, 5, probes=12)
    assert lists.recall(lists.neighbours(df, asked, centroids, 5, probes=most), truth) == 1.0
    assert lists.recall(lists.neighbours(df, asked, centroids, 5, probes=few), truth) >= 0.5


def test_question_reads_its_lists_alone(spark, clouds, tmp_path):
    df, rows = clouds
    centroids = lists.fit(df, lists=12)
    path = f"file://{tmp_path}/lists"
    lists.write_lists(df, centroids, path, files=2)
    assert spark.read.parquet(path).count() == len(rows)
    hits = lists.search(spark, path, centroids, rows[0][1], 7, probes=2)
    assert re.search(r"PartitionFilters: \[[^\]]*list", hits._jdf.queryExecution().executedPlan().toString())
    read = spark.read.parquet(path).where(F.col("list").isin(lists.probed(centroids, rows[0][1], 2)))
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).collect()}
    assert files(read) < files(spark.read.parquet(path))
    whole = lists.search(spark, path, centroids, rows[0][1], 7, probes=12)
    assert {r["vec_id"] for r in whole.collect()} == {0, *range(1000, 1006)}


def test_null_zero_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    centroids = lists.fit(df)
    got = lists.neighbours(df, df, centroids, 2, probes=len(centroids)).collect()
    assert {(r["vec_id"], r["place"], r["other_id"]) for r in got} == {(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)}
    assert lists.neighbours(df.limit(0), df, centroids, 2).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        lists.fit(df.where("vec_id = 3"))
