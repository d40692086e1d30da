"""Every query with an oracle equals DuckDB on the smallest tables; the others return a stable schema."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__  # noqa: F401  registers the queries
from attesta.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, FOLDER)
    assert ok, message


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() >= 0
