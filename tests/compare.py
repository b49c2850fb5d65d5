"""Runs a query and its SQL and compares rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set threads = 2")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def assert_same(spark, c, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    got = sorted(repr(tuple(r)) for r in df.collect())
    result = c.sql(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(x) for x in df.columns]
    want = sorted(repr(tuple(r[k] for k in at)) for r in result.fetchall())
    assert got == want
