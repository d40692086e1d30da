"""Named queries: each runs one operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attesta.plans.tables import Tables, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``build(tables)`` under ``name`` with its DuckDB equivalent."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, oracle(sql, views) if sql else None)
        return build

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name].build(Tables(spark, folder))
