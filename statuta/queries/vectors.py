"""Nearest vectors through lists around centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_lists as lists
from ..sinks import shared_folder
from ..sources import views as v
from . import query

_EXACT = """SELECT q.vec_id, e.vec_id AS other_id, ROUND(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
(ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id))::INTEGER AS place FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id"""


def _asked(spark, sf_dir):
    e = v.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.where(F.col("vec_id") % 20 == 0), lists.fit(e)


@query(f"SELECT vec_id, place, other_id, distance FROM ({_EXACT}) WHERE place <= 10")
def knn_all_lists(spark, sf_dir):
    """O2: the ten nearest of every twentieth vector with all lists read: exact."""
    e, asked, centroids = _asked(spark, sf_dir)
    return lists.neighbours(e, asked, centroids, 10, probes=len(centroids)).select("vec_id", "place", "other_id", F.round("distance", 6).alias("distance"))


@query()
def knn_lists(spark, sf_dir):
    """O2: the ten nearest of every twentieth vector in as many lists as a measured recall asks for."""
    e, asked, centroids = _asked(spark, sf_dir)
    return lists.neighbours(e, asked, centroids, 10, lists.enough_probes(e, centroids, 10)).select("vec_id", "place", "other_id", F.round("distance", 6).alias("distance"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, ROUND(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 10""")
def knn_stored_filtered(spark, sf_dir):
    """A metadata filter over stored lists, all of them probed."""
    e = v.read(spark, sf_dir, "embeddings")
    centroids, path = lists.fit(e), shared_folder(spark, "vector-lists")
    lists.write_lists(e, centroids, path)
    [q] = e.where("vec_id = 0").select("embedding").collect()
    return lists.search(spark, path, centroids, q[0], 10, probes=len(centroids), where=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))
