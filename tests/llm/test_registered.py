"""Each registered query with SQL equals DuckDB on the smallest tables; the rest run and keep every row."""

from __future__ import annotations

import pytest
from oracle_check import connect, normal

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
OURS = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OURS) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in OURS if n in entry.oracle_sql()])
def test_equals_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    result = connect(FOLDER).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), columns)
