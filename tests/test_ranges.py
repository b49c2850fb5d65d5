"""Scans over document order: short ranges and long ones tell the same, as does a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import blocks, sequences as q


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(11)
    rows = [(d, p, rng.choice([None, 0, 1, 1, 2, 3]), f"t{d}{p}", rng.choice("aab")) for d in ("x", "y", None) for p in range(-3, 160 if d == "x" else 25)]
    return spark.createDataFrame(rows, "doc string, pos int, lev int, t string, v string").repartition(5), rows


def docs(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("rows", [1 << 16, 10, 1])
def test_carried_headings(lines, rows):
    df, all_rows = lines
    want = {}
    for d, rs in docs(all_rows).items():
        held = [None] * 4
        for r in rs:
            if r[2] is not None and 1 <= r[2] <= 4:
                held[r[2] - 1 :] = [r[3]] + [None] * (4 - r[2])
            want[d, r[1]] = tuple(held)
    got = {(r["doc"], r["pos"]): (r["h1"], r["h2"], r["h3"], r["h4"]) for r in q.carried_headings(df, "doc", "pos", F.col("lev"), "t", rows=rows).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [1 << 16, 10, 1])
def test_runs_nearest_and_segments(lines, rows):
    df, all_rows = lines
    run, near, seg = {}, {}, {}
    for d, rs in docs(all_rows).items():
        n, last, heading = 0, None, None
        for k, r in enumerate(rs):
            n += not k or rs[k - 1][4] != r[4]
            run[d, r[1]] = n
            near[d, r[1]] = last
            last = r[3] if r[2] == 0 else last
            if r[2] == 1:
                heading = (heading or 0) + 1
                seg[d, heading] = [r[3]]
            else:
                seg.setdefault((d, heading or 0), [None]).append(r[3])
    assert {(r["doc"], r["pos"]): r["run"] for r in q.runs(df, ["doc"], "pos", "v", rows).collect()} == run
    assert {(r["doc"], r["pos"]): r["z"] for r in q.nearest_before(df, ["doc"], "pos", F.col("lev") == 0, F.col("t"), "z", rows).collect()} == near
    got = {(r["doc"], r["segment"]): [r["heading"], *(r["body"].split("\n") if r["body"] else [])] for r in q.segments(df, "doc", "pos", F.col("lev") == 1, "t", rows).collect()}
    assert got == seg


def test_pages_and_paragraphs_by_short_ranges(spark, sf_dir):
    from statuta.queries.pages import _blocks

    b = _blocks(spark, sf_dir).where("doc_id < 12").withColumn("doc", F.lit("Doc"))
    for f in (lambda n: blocks.structured(b, "doc_id", "pos", n), lambda n: blocks.articles(b, "doc_id", "pos", "doc", n), lambda n: blocks.paragraphs(b, "doc_id", "pos", "text", n)):
        long, short = (sorted(map(repr, f(n).collect())) for n in (1 << 16, 10))
        assert long and long == short


def test_one_long_document_is_many_tasks(spark):
    """With ranges, no task sorts more rows than a range holds."""
    df = spark.range(4000).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.lit(1).alias("lev"), F.lit("t").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = q.carried_headings(df, "doc", "pos", F.col("lev"), "t", rows=100)
        per = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) > 1 and max(r["count"] for r in per) < 4000


def test_rows_are_dealt_once_for_all_scans(spark):
    """Both scans of the pages' structure leave rows where one shuffle brought them; a null group is a group too."""
    from statuta.operators import blocks as b
    from statuta.operators import sequences as q

    rows = [(None if k % 3 == 0 else f"d{k % 3}", k, "S UBPART A" if k % 50 < 3 else f"CS 25.{k} Scope" if k % 5 == 1 else f"line {k}", 20.0 if k % 50 < 3 else 10.0, k % 5 < 2) for k in range(300)]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, size double, bold boolean").repartition(3)
    got = {rows: sorted(map(repr, b.structured(df, "doc", "pos", rows=rows).collect())) for rows in (7, 1 << 16)}
    assert got[7] == got[1 << 16]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = b.structured(df, "doc", "pos")._jdf.queryExecution().executedPlan().toString().splitlines()
        runs = q.runs(df, ["doc"], "pos", "bold")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the joins' left sides have no shuffle of their own: from the last join down, the first child's one is the windows'
    for p, joins in ((plan, 2), (runs, 2)):
        left, seen = [], 0
        for line in p:
            if "SortMergeJoin" in line:
                seen += 1
            if "Exchange" in line:
                left.append(seen)
                break
        assert left == [joins]  # both joins stand above the first shuffle on the way down the left side
    same = {r["pos"]: r["run"] for r in q.runs(df, ["doc"], "pos", "bold", rows=7).collect()}
    assert same == {r["pos"]: r["run"] for r in q.runs(df, ["doc"], "pos", "bold").collect()}
    mine, n, was = [r for r in rows if r[0] is None], 0, None
    for r in mine:
        n, was = n + (r[4] is not was), r[4]
        assert same[r[1]] == n
