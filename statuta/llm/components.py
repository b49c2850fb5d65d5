"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, staged


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id it reaches.

    Large-star and small-star rounds: each round hangs a node's neighbours on the smallest of
    them. Every round is a group-by and is written to the shared folder; edges stay linear in
    number and the rounds logarithmic in the longest path. The node in the middle of a large star
    is a hot key of the joins. No links give no rows.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members"))
        low = low.select("a", F.least("a", "m").alias("m"), "members")
        # large star: neighbours above a node hang on its smallest neighbour
        big = join_hot(both.where("b > a"), low, ["a"], 2 * edges.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node and its smaller neighbours hang on the smallest of them
        big = staged(big.distinct(), "cc-large")
        low = big.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members"))
        small = join_hot(big, low, ["a"], big.count())
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        new = staged(small.distinct(), "cc-small")
        # done when every node hangs on a root and no root hangs on another node
        roots = new.select(F.col("b").alias("a")).distinct()
        twice = new.groupBy("a").count().where("count > 1").select("a")
        if new.join(roots, "a", "left_semi").select("a").union(twice).isEmpty():
            return new.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select(F.col("a").alias("id"), F.col("a").alias("component")))
        edges = new
