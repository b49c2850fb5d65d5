"""The change log as a stream and as runs, failures, repeats and progress."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statuta.streaming import jobs

DDL = "reference_code string, source_doc_id string, content_hash string, place int"


@pytest.fixture
def log(tmp_path):
    return jobs.ChangeLog(f"file://{tmp_path}/log", ("reference_code",), ("place",), buckets=4)


def events(log, spark, number=None):
    rows = log.events(spark, spark.createDataFrame([], DDL).schema, number).collect()
    return {(r["batch_no"], r["reference_code"], r["change_type"], r["repeats"]) for r in rows}


def state(log, spark):
    return {(r["reference_code"], r["content_hash"]) for r in log.state(spark, spark.createDataFrame([], DDL).schema).collect()}


def test_runs_against_a_plain_model(spark, log):
    """Three runs, each compared with dictionaries; every one is applied twice."""
    batches = [
        [("a", "d1", "1", 0), ("b", "d1", "1", 1), ("c", "d2", "1", 2), ("k", None, "1", 3)],
        [("a", "d1", "1", 0), ("x", "d1", "9", 1), ("x", "d1", "8", 2), ("x", "d3", "7", 3)],
        [("b", "d3", "2", 0), ("c", "d9", None, 1)],
    ]
    held: dict[str, tuple] = {}
    for number, rows in enumerate(batches):
        want = set()
        first, last = {}, {}
        for r in rows:
            first.setdefault(r[0], r)
            last[r[0]] = r
        for k in first:
            kind = "added" if k not in held else "unchanged" if held[k][2] == first[k][2] else "modified"
            want.add((number, k, kind, sum(r[0] == k for r in rows) - 1))
        for k, r in list(held.items()):
            if k not in last and r[1] is not None and r[1] in {x[1] for x in rows}:
                want.add((number, k, "deleted", 0))
                del held[k]
        held |= last
        for _ in range(2):
            log.apply(spark.createDataFrame(rows, DDL), number)
            assert events(log, spark, number) == want
            assert state(log, spark) == {(k, r[2]) for k, r in held.items()}
        if number == 1:
            log.compact(spark, spark.createDataFrame([], DDL).schema)
            assert state(log, spark) == {(k, r[2]) for k, r in held.items()}


def test_no_run_and_empty_run(spark, log):
    schema = spark.createDataFrame([], DDL).schema
    log.compact(spark, schema)
    assert state(log, spark) == set() and events(log, spark) == set()
    log.apply(spark.createDataFrame([], DDL), 0)
    assert state(log, spark) == set() and events(log, spark) == set()


def test_compaction_leaves_untouched_buckets(spark, log):
    schema = spark.createDataFrame([], DDL).schema
    log.apply(spark.createDataFrame([(f"k{i}", f"d{i}", "1", 0) for i in range(40)], DDL), 0)
    log.compact(spark, schema)
    log.apply(spark.createDataFrame([("k7", "d7", "2", 0)], DDL), 1)
    log.compact(spark, schema)
    runs = log._runs(spark, "base")
    assert len(runs[0]) == 4 and len(runs[1]) == 1
    assert state(log, spark) == {(f"k{i}", "2" if i == 7 else "1") for i in range(40)}


def test_stream_equals_runs_after_a_failure(spark, log, tmp_path):
    """A run that fails half way is not seen, and comes out right when it runs again."""
    land, cp = str(tmp_path / "land"), str(tmp_path / "cp")
    rows = lambda lo, hi, h: spark.range(lo, hi).select(F.concat(F.lit("r"), "id").alias("reference_code"), F.lit("d").alias("source_doc_id"), F.lit(h).alias("content_hash"), F.lit(0).alias("place"))
    stream = lambda: jobs.read_table_as_stream(spark, land, rows(0, 1, "").schema)
    progress = jobs.ProgressLog(most=3)
    spark.streams.addListener(progress)
    rows(0, 30, "1").coalesce(1).write.parquet(land)
    jobs.harvest(stream(), log, cp).awaitTermination()
    rows(10, 40, "2").coalesce(1).write.mode("append").parquet(land)

    class Broken(jobs.ChangeLog):
        def apply(self, batch, number):
            batch.limit(3).write.mode("overwrite").parquet(f"{self.folder}/delta/batch_no={number}/bucket=0")
            raise RuntimeError("lost")

    broken = Broken(log.folder, log.keys, log.order, buckets=4)
    with pytest.raises(Exception, match="lost"):
        jobs.harvest(stream(), broken, cp).awaitTermination()
    assert len(state(log, spark)) == 30
    jobs.harvest(stream(), log, cp).awaitTermination()
    twin = jobs.ChangeLog(f"file://{tmp_path}/twin", ("reference_code",), ("place",), buckets=4)
    twin.apply(rows(0, 30, "1"), 0)
    twin.apply(rows(10, 40, "2"), 1)
    assert events(log, spark) == events(twin, spark) and state(log, spark) == state(twin, spark)
    assert {k for *_, k, _ in events(log, spark, 1)} == {"added", "modified", "deleted"}
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    lines = progress.table(spark).collect()
    spark.streams.removeListener(progress)
    assert 0 < len(lines) <= 3 and lines[-1]["line"].startswith("ended")
