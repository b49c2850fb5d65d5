"""Deduplication that keeps an order: first wins, last wins, numbering, ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Of the rows of a key the first by pos, which no two rows share; rows without a pos go. Only keys and positions
    are aggregated, by hash with a map-side combine; rows then stay by their position."""
    first = df.groupBy(*keys).agg(F.min(pos).alias("_first")).select("_first")
    return df.join(first, df[pos] == first["_first"], "left_semi")


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last row of a key, at the place where the key was first seen (first_pos)."""
    ends = df.groupBy(*keys).agg(F.max(pos).alias("_last"), F.min(pos).alias("first_pos")).select("_last", "first_pos")
    return df.join(ends, df[pos] == ends["_last"]).drop("_last")


def numbered(df: DataFrame, key: str, pos: str, out: str) -> DataFrame:
    """The k-th repeat of a key gets the suffix `` (k)``."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn(out, F.when(k > 1, F.concat(F.col(key), F.lit(" ("), k, F.lit(")"))).otherwise(F.col(key)))


def keep_unseen(hits: Column, id_of, ref_of) -> Column:
    """Of a short ordered array the items whose id and reference were not *kept* before
    (skipped items do not register). A fold within the row."""
    kept = F.filter(hits, lambda h: F.lit(False))
    return F.aggregate(hits, kept, lambda acc, h: F.when(F.exists(acc, lambda k: (id_of(k) == id_of(h)) | (ref_of(k) == ref_of(h))), acc).otherwise(F.concat(acc, F.array(h))))
