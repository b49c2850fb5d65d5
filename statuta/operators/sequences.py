"""Loops over document order as windows: carried headings, segments, as-of parents, runs."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions that one task walks through; a longer document is several tasks' work.
RANGE_ROWS = 1 << 16


def ranged(df: DataFrame, group: list[str], pos: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with _at, its group and the range of ``rows`` positions that a row is in, as one value that is never null.
    Rows are dealt by it once: what carried() and counted() add to a range, and what its earlier ranges hand
    on, comes where the rows are. Callers that scan several times call this first and drop _at at last."""
    return df.withColumn("_at", F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.floor(F.col(pos) / rows).alias("r")))


def _windows(group: list[str], pos: str, here: bool = True) -> tuple[Window, Window]:
    """Up to a row within its range; the ranges before one in its group."""
    within = Window.partitionBy("_at").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    return within, Window.partitionBy(*[f"_at.g{i}" for i in range(len(group))]).orderBy("_at.r").rowsBetween(Window.unboundedPreceding, -1)


def _handed(df: DataFrame, ends: DataFrame, names: list[str]) -> DataFrame:
    """df with what ends (_at, names) tells of the range. The keys are equal as structs, also where a group is null, so
    rows stay where the window brought them; ranges that are handed nothing have no row."""
    ends = ends.where(functools.reduce(operator.or_, [F.col(n).isNotNull() for n in names]))
    ends = ends.select(F.col("_at").alias("_e"), *names)
    return df.join(ends, F.col("_at") == F.col("_e"), "left").drop("_e")


def carried(df: DataFrame, group: list[str], pos: str, values: dict[str, Column], here: bool = True, rows: int = RANGE_ROWS) -> DataFrame:
    """df with, under each name, the last value of its group that is not null, up to the row (here) or
    before it.

    A scan in two levels: windows within ranges of ``rows`` positions, the last values of each
    range handed on to the later ranges of the group, one row a range. Positions are numbers, one
    row a position of a group. A group of any length is many tasks' work.
    """
    names, dealt = list(values), "_at" in df.columns
    df = (df if dealt else ranged(df, group, pos, rows)).withColumns({f"_v_{n}": c for n, c in values.items()})
    within, earlier = _windows(group, pos, here)
    ends = df.groupBy("_at").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(n) for n in names])
    ends = ends.select("_at", *[F.last(n, ignorenulls=True).over(earlier).alias(f"_h_{n}") for n in names])
    df = df.withColumns({f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in names})
    df = _handed(df, ends, [f"_h_{n}" for n in names])
    df = df.withColumns({n: F.coalesce(f"_w_{n}", f"_h_{n}") for n in names})
    return df.drop(*([] if dealt else ["_at"]), *[f"_{k}_{n}" for k in "vwh" for n in names])


def counted(df: DataFrame, group: list[str], pos: str, flag: Column, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with how many rows of the group, up to this one, have the flag; in two levels like carried()."""
    dealt = "_at" in df.columns
    df = (df if dealt else ranged(df, group, pos, rows)).withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0)))
    within, earlier = _windows(group, pos)
    ends = df.groupBy("_at").agg(F.sum("_flag").alias("_n")).select("_at", F.sum("_n").over(earlier).alias("_before"))
    df = _handed(df.withColumn(out, F.sum("_flag").over(within)), ends, ["_before"])
    return df.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_flag", "_before", *([] if dealt else ["_at"]))


def carried_headings(df: DataFrame, doc: str, pos: str, level: Column, title: str, levels: int = 4, rows: int = RANGE_ROWS) -> DataFrame:
    """Df with h1..hN, the headings in force at each row: the last of a level, unless a
    shallower one came after it."""
    here = F.struct(F.col(pos).alias("p"), F.col(title).alias("t"))
    df = carried(df, [doc], pos, {f"_l{k}": F.when(level == k, here) for k in range(1, levels + 1)}, rows=rows)
    out = {}
    for k in range(1, levels + 1):
        stale = F.lit(False)
        for j in range(1, k):
            stale = stale | F.coalesce(F.col(f"_l{j}.p") > F.col(f"_l{k}.p"), F.lit(False))
        out[f"h{k}"] = F.when(~stale, F.col(f"_l{k}.t"))
    return df.withColumns(out).drop(*[f"_l{k}" for k in range(1, levels + 1)])


def nearest_before(df: DataFrame, group: list[str], pos: str, eligible: Column, value: Column, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The value of the nearest eligible row before each row of its group (a backward as-of)."""
    return carried(df, group, pos, {out: F.when(eligible, value)}, here=False, rows=rows)


def segments(lines: DataFrame, doc: str, pos: str, starts: Column, text: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc, segment, first_pos, heading, body, n_lines): a heading and the lines up to the next.

    Lines before the first heading are segment 0 without a heading. One segment's lines are one
    row, as its body is one text.
    """
    df = counted(lines.withColumn("_start", F.coalesce(starts, F.lit(False))), [doc], pos, F.col("_start"), "segment", rows)
    g = df.groupBy(doc, "segment").agg(F.min(pos).alias("first_pos"), F.max(F.when(F.col("_start"), F.col(text))).alias("heading"), F.sort_array(F.collect_list(F.when(~F.col("_start"), F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))).alias("_b"))
    return g.select(doc, "segment", "first_pos", "heading", F.array_join(F.col("_b.t"), "\n").alias("body"), F.size("_b").cast("long").alias("n_lines"))


def runs(df: DataFrame, group: list[str], pos: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Df with run, the number of the stretch of equal neighbouring values (gaps and islands)."""
    df = carried(ranged(df, group, pos, rows), group, pos, {"_was": F.struct(F.col(value).alias("v"))}, here=False, rows=rows)
    same = F.col("_was").isNotNull() & F.col("_was.v").eqNullSafe(F.col(value))
    return counted(df, group, pos, ~same, "run", rows).drop("_was", "_at")


def ancestor_paths(sections: DataFrame, doc: str, pos: str, code: str, title: str) -> DataFrame:
    """Df with ancestors, the ``code title`` of each prefix of a dotted code (``4.1.2`` has 4 and
    4.1), the last one before the row; a prefix that never came is its code alone.

    Sections and the prefixes that are asked for stand in one table, ordered by place: the last
    title before an ask is a window's, so no section meets all earlier ones of its code.
    """
    parts = F.split(code, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("prefix")))
    asks = sections.where(F.size(parts) > 1).select(F.col(doc).alias("d"), F.col(pos).alias("p"), F.explode(prefixes).alias("x")).select("d", "p", "x.k", "x.prefix", F.lit(None).cast("string").alias("t"))
    known = sections.select(F.col(doc).alias("d"), F.col(pos).alias("p"), F.lit(0).alias("k"), F.col(code).alias("prefix"), F.col(title).alias("t"))
    # an ask comes before the section at its own place
    w = Window.partitionBy("d", "prefix").orderBy("p", F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = asks.unionByName(known).withColumn("t", F.last("t", ignorenulls=True).over(w)).where("k > 0")
    path = found.groupBy("d", "p").agg(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(" ", "prefix", "t").alias("n")))).alias("a"))  # as many as a code has parts
    joined = sections.join(path, (sections[doc] == path["d"]) & (sections[pos] == path["p"]), "left")
    return joined.withColumn("ancestors", F.coalesce(F.array_join("a.n", " / "), F.lit(""))).drop("d", "p", "a")
