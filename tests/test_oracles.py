"""Every query with SQL against DuckDB, the others for rows and a stable result."""

from __future__ import annotations

import pytest

from statuta.catalog_of_queries import ORACLES, QUERIES
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert_same(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_and_reruns(spark, sf_dir, name):
    first, again = (sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
