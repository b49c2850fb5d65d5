"""Keyed writes and runs that are seen whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statuta.operators import keyed
from statuta.sinks.manifest import Runs

STORED = "source_id string, external_id string, name string, base_url string, format string, frequency string, enabled boolean, last_sync_at int"
NEW = "external_id string, name string, base_url string, format string, frequency string, pos int"


def sources(spark, old, new):
    o = spark.createDataFrame([(*r, "xml", "w", e, 1) for *r, e in old], STORED)
    n = spark.createDataFrame([(x, name, url, "pdf", "d", k) for k, (x, name, url) in enumerate(new)], NEW).repartition(3)
    return {(r["external_id"], r["name"]): (r["source_id"], r["base_url"], r["format"], r["enabled"], r["last_sync_at"]) for r in keyed.upsert_sources(o, n, F.lit(2)).collect()}


def test_sources_by_id_else_by_name(spark):
    old = [("1", "a", "A", "u", False), ("2", None, "B", "u", True), ("3", "c", "C", "u", False), ("4", "d", "D", "u", True)]
    new = [("a", "A2", "v"), (None, "B", "v"), ("b", "B", "w"), (None, "C", "v"), ("e", "D", "v"), (None, "N", "v"), ("n", "N2", "v"), ("n", "N3", "w"), (None, None, "x")]
    got = sources(spark, old, new)
    assert got["a", "A2"] == ("1", "v", "pdf", False, 2)  # renamed, stays off
    assert got["b", "B"] == ("2", "w", "pdf", True, 2)  # a nameless row took an id; the later row counts
    assert got["c", "C"] == ("3", "v", "pdf", False, 2)  # by name, its id stays
    assert got["d", "D"] == ("4", "u", "xml", True, 1)  # another id does not take its name's row
    assert got["e", "D"][1:] == ("v", "pdf", True, 2) and got[None, "N"][1:] == ("v", "pdf", True, 2) and got["n", "N3"][1] == "w"
    assert len(got) == 7
    assert sources(spark, [], []) == {} and len(sources(spark, old, [])) == 4
    assert sources(spark, [], new[:1]) == sources(spark, [], new[:1])


def test_last_row_of_a_key(spark):
    rows = [(1, "x", 5), (1, "y", 7), (1, "z", 7), (None, "n", 1), (None, "m", None)]
    got = sorted(map(repr, keyed.last_of(spark.createDataFrame(rows, "k int, v string, pos int"), ["k"], "pos").collect()))
    assert got == ["Row(k=1, v='z')", "Row(k=None, v='n')"]


def test_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    assert runs.latest() is None and runs.places() == {}
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    ids = lambda name, run=None: sorted(r["i"] for r in runs.table(name, run).collect())
    assert runs.write({"nodes": df(1), "edges": df(10)}) == 0

    def broken(r):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        runs.write({"nodes": df(1, 2), "edges": broken})
    assert runs.latest() == 0 and ids("nodes") == [1] and ids("edges") == [10]
    # the manifest itself breaks: its folder is there, its _SUCCESS is not
    (tmp_path / "runs" / "manifest" / "run=1").mkdir()
    assert runs.latest() == 0
    assert runs.write({"nodes": lambda r: r.table("nodes").union(df(3))}) == 1
    assert ids("nodes") == [1, 3] and ids("edges") == [10] and ids("nodes", 0) == [1]
    with pytest.raises(ValueError, match="finished"):
        runs.write({"nodes": df(9)}, run=1)
