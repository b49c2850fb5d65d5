"""Operator 2: mixing sources to target weights.

Tokens are summed per source, targets come from weights with a ceiling on repetition, and
each document is emitted floor(rate) times plus one copy with the probability of the
fraction, decided by a hash of its id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_broadcast, free_name, n_words, staged

#: No source is repeated more often than this.
MOST_REPEATS = 3
SEED = "mix-1"
SALTS = 32


def code_point_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): sources in code point order, null last, take the weights in turn.

    One row per source is ordered; this table has no document in it.
    """
    # binary order of UTF-8 is code point order
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (at % len(cycle) + 1).cast("int"))
    return sources.select("source", weight.cast("long").alias("weight"))


def targets(totals: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    Targets share the grand total by weight; none is above ``most`` times its source's size
    and what is cut off is shared again by weight. The level L with
    sum(min(L * weight, most * size)) = total is the largest of
    (total - capped before) / (weight - weight before) with sources ordered by size/weight.
    """
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(most) * F.col("source_size")
    df = totals.select(
        "*",
        cap.alias("_cap"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weight_left"),
    )
    level = F.max(F.col("_left").cast("double") / F.col("_weight_left").cast("double")).over(everything)
    return df.select("source", "source_size", F.least(level * F.col("weight"), F.col("_cap").cast("double")).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the key's text and the seed."""
    h = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, weights=code_point_weights, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs.

    Null texts have size 0; a null source is a source of its own; rows with one doc_id get
    equal draws; an empty table gives an empty result.
    """
    sizes = staged(docs.select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = staged(totals, "mix-totals")
    goal = staged(targets(_weighted(totals, weights), most), "mix-targets")
    goal = goal.withColumnRenamed("source", "_goal_source")
    goal, small = bounded_broadcast(goal)
    if small:
        out = sizes.join(goal, sizes["source"].eqNullSafe(goal["_goal_source"]), "left")
    else:  # more sources than may be broadcast: a hot one is spread over salts
        sizes = sizes.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        goal = goal.withColumn("_goal_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = sizes.join(goal, sizes["source"].eqNullSafe(goal["_goal_source"]) & (sizes["_salt"] == goal["_goal_salt"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.select("doc_id", "source", "size", "source_size", "target", rate.alias("_rate"))
    copies = F.floor("_rate") + F.when(uniform(F.col("doc_id"), seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _weighted(totals: DataFrame, weights) -> DataFrame:
    w = weights(totals.select("source")).withColumnRenamed("source", "_w")
    return totals.join(w, totals["source"].eqNullSafe(w["_w"]), "inner").select("source", "source_size", "weight")


def mix(docs: DataFrame, weights=code_point_weights, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs with every row repeated as the mix wants; its columns, in its order.

    The rates depend on the source alone, so they are joined as one row per source and the
    texts are not shuffled when that table is small.
    """
    rate_name, key, n = free_name(docs, "mix_rate", "mix_source", "mix_n")
    kept = docs.columns
    sizes = docs.select("source", n_words("text").alias("size"))
    totals = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    goal = targets(_weighted(totals, weights), most)
    goal = staged(goal.select(F.col("source").alias(key), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate_name)), "mix-rates")
    goal, small = bounded_broadcast(goal)
    on = docs["source"].eqNullSafe(goal[key])
    if not small:
        salt, other = free_name(docs, "mix_salt", "mix_other")
        docs = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        goal = goal.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = docs["source"].eqNullSafe(goal[key]) & (docs[salt] == goal[other])
    rate = F.col(rate_name)
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return docs.join(goal, on, "left").select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(n)).drop(n)
