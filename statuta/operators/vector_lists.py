"""Approximate nearest vectors: an inverted file of lists around centroids.

Every vector is stored in the list of its nearest centroid, a partition of the table; a question
reads the lists of the few centroids nearest to it and compares exactly within them. Centroids are
fitted on a bounded sample; all vectors are stored. Reading all lists gives the exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .retrieval import nearest

#: Lists at most, and sampled vectors a list for fitting: the fit holds at most their product.
MOST_LISTS, SAMPLE = 4096, 64
#: Of the lists, the share that a question reads unless told otherwise; at least LEAST_PROBES.
PROBED, LEAST_PROBES = 0.25, 4
#: Recall that enough_probes() aims at, and the questions it measures it on.
TARGET, QUESTIONS = 0.95, 128
#: Vectors of a list that meet their questions in one task, on average.
PART_ROWS = 65_536


def n_lists(rows: int) -> int:
    """As many lists as a list has vectors, up to MOST_LISTS."""
    return max(1, min(MOST_LISTS, math.isqrt(rows)))


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids (lists x dimensions) of cosine k-means over a sample: the ``sample`` x lists
    vectors with the smallest hash of their id. Null and zero vectors are left out. The centroids are a
    table of bounded size, which the driver keeps."""
    usable = vectors.where("embedding IS NOT NULL AND exists(embedding, x -> x <> 0)")
    lists = lists or n_lists(usable.count())
    some = usable.select("vec_id", F.xxhash64("vec_id").alias("h"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).orderBy("h", "vec_id").limit(sample * lists)
    points = some.select(array_to_vector("e").alias("features"))
    if points.isEmpty():
        raise ValueError("no vector to fit lists on")
    model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(points) if lists > 1 else None
    at = np.array(model.clusterCenters()) if model else np.array([r["features"].toArray() for r in points.limit(1).collect()])
    return at / np.linalg.norm(at, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows; zero where one is null."""
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, int(whole.sum()))
    out = np.zeros((len(column), width))
    out[whole] = flat.reshape(-1, width) if width else 0
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def assigned(vectors: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """vectors with list: a row for each of the ``probes`` nearest centroids, nearest first. Null and
    zero vectors, which are near to nothing, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(b.schema.get_field_index("embedding")))
            some = np.flatnonzero(np.any(m != 0, axis=1))
            if not len(some):
                continue
            best = np.argsort(-(_unit(m[some]) @ centroids.T), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(some, best.shape[1]))
            yield pa.record_batch([*(c.take(rows) for c in b.columns), pa.array(best.ravel().astype(np.int32))], [*b.schema.names, "list"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("list", IntegerType())]))


def write_lists(vectors: DataFrame, centroids: np.ndarray, path: str, files: int = 1) -> None:
    """Stores all vectors by list. A list is written by ``files`` tasks, so that a large one is no single
    task's; within a file ids ascend."""
    rows = assigned(vectors, centroids)
    rows = rows.repartition(len(centroids) * files, "list", F.pmod(F.xxhash64("vec_id"), F.lit(files))).sortWithinPartitions("list", "vec_id")
    rows.write.mode("overwrite").partitionBy("list").parquet(path)


def probed(centroids: np.ndarray, query: list[float], probes: int | None = None) -> list[int]:
    """The lists nearest to a vector, as many as asked for."""
    probes = probes or max(LEAST_PROBES, math.ceil(PROBED * len(centroids)))
    return np.argsort(-(centroids @ np.array(query, dtype=np.float64)), kind="stable")[:probes].tolist()


def search(spark: SparkSession, path: str, centroids: np.ndarray, query: list[float], n: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """The n nearest of the probed lists, after a filter; other lists' files are not read."""
    rows = spark.read.parquet(path).where(F.col("list").isin(probed(centroids, query, probes)))
    return nearest(rows, query, n, where)


def _best(n: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """The n nearest vectors (right) of each question (left) in a part of a list, some questions at a time."""
        ids, vectors = right["vec_id"].to_numpy(), _unit(_matrix(right["embedding"].combine_chunks()))
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        asked, questions = left["vec_id"].to_numpy(), _unit(_matrix(left["embedding"].combine_chunks()))
        out = []
        if len(ids):
            step = max(1, (1 << 22) // len(ids))
            for a in range(0, len(asked), step):
                far = 1 - questions[a : a + step] @ vectors.T
                own = asked[a : a + step, None] == ids
                far[own] = np.inf
                k = min(n, len(ids))
                near = np.argsort(far, axis=1, kind="stable")[:, :k]  # ties by id
                value = np.take_along_axis(far, near, axis=1)
                i, j = np.nonzero(np.isfinite(value))
                out.append(pa.table({"vec_id": asked[a + i], "list": np.full(len(i), key[0].as_py(), dtype=np.int32), "other_id": ids[near[i, j]], "distance": value[i, j]}))
        return pa.concat_tables(out) if out else pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("other_id", pa.int64()), ("distance", pa.float64())]).empty_table()

    return run


def neighbours(vectors: DataFrame, questions: DataFrame, centroids: np.ndarray, n: int, probes: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, place, other_id, distance, list): for every question (vec_id, embedding) its n nearest other
    vectors among those of the probed lists, ties to the smaller id, and the list it is in.

    Questions meet the lists' parts by an equi-join of (list, part): a list with more vectors than
    part_rows is dealt to several parts, each of which sees the list's questions, so a list that
    holds a third of all vectors is many tasks' work. Ids are numbers, one row an id.
    """
    probes = probes or max(LEAST_PROBES, math.ceil(PROBED * len(centroids)))
    stored = assigned(vectors.select("vec_id", "embedding"), centroids)
    parts = {r["list"]: -(-r["count"] // part_rows) for r in stored.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    if not parts:
        return questions.select("vec_id", F.lit(0).alias("place"), F.col("vec_id").alias("other_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("list")).limit(0)
    several = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("list")), F.lit(1)).cast("int")
    stored = stored.withColumn("part", F.pmod(F.xxhash64("vec_id"), several).cast("int"))
    asked = assigned(questions.select("vec_id", "embedding"), centroids, probes).withColumn("part", F.explode(F.sequence(F.lit(0), several - 1)))
    hits = asked.groupBy("list", "part").cogroup(stored.groupBy("list", "part")).applyInArrow(_best(n), "vec_id long, list int, other_id long, distance double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "other_id"))
    return hits.withColumn("place", place).where(F.col("place") <= n).select("vec_id", "place", "other_id", "distance", "list")


def enough_probes(vectors: DataFrame, centroids: np.ndarray, n: int, target: float = TARGET, questions: int = QUESTIONS) -> int:
    """How many lists to read for a recall of ``target``: measured on the vectors with the smallest hash
    of their id, ``questions`` of them, whose true neighbours are found with all lists. A neighbour is
    found once the list that holds it is read, so one pass tells it for every number of lists."""
    some = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(questions)
    asked = {r["vec_id"]: r["embedding"] for r in some.collect()}
    truth = neighbours(vectors, some.select("vec_id", "embedding"), centroids, n, probes=len(centroids)).select("vec_id", "list").collect()
    order = {i: {at: k for k, at in enumerate(probed(centroids, q, len(centroids)))} for i, q in asked.items()}
    ranks = sorted(order[r["vec_id"]][r["list"]] for r in truth)
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else 1


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of true (vec_id, other_id) rows that were found."""
    pairs = lambda df: df.select("vec_id", "other_id")
    n, met = truth.count(), pairs(found).intersect(pairs(truth)).count()
    return met / n if n else 1.0
