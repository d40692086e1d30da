"""Queries equal their SQL on rows that the given tables lack: empty documents, turns of one word."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from attesta.plans.registry import QUERIES, runnable

DOCUMENTS = [(4, "First line of it.\nSecond line of it.", "en"), (9, "", "en"), (10, "", "de"), (12, " \n ", "en"), (13, None, "en"), (18, "One line.", "de")]
TURNS = [(1, 3, "user", "One."), (1, 2, "user", "Two words."), (2, 7, "user", ""), (3, 1, "system", None), (5, 0, "user", "Of another record.")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", DOCUMENTS)
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    con.execute(f"COPY (SELECT *, 'src1' AS source, CAST(length(text) AS BIGINT) AS n_chars FROM documents) TO '{path}/documents.parquet'")
    con.execute(f"COPY conversations TO '{path}/conversations.parquet'")
    return path


def _equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = runnable(name)(spark, folder)
    rows = con.execute(f"SELECT {', '.join(found.columns)} FROM ({QUERIES[name].sql})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str) and rows


def test_units_of_short_turns(spark, folder):
    _equals_its_sql(spark, folder, "src_10_unit_pages")


def test_issues_of_papers_with_a_claim(spark, folder):
    _equals_its_sql(spark, folder, "aud_25_26_artifact_issues")


def test_issues_of_papers_without_a_claim_are_counted(spark, folder):
    _equals_its_sql(spark, folder, "aud_25b_issue_counts")
    counts = {(r.path, r.code): r.n for r in runnable("aud_25b_issue_counts")(spark, folder).collect()}
    assert counts["logic.claims", "missing"] == 4


def test_chunks_of_empty_documents(spark, folder):
    _equals_its_sql(spark, folder, "doc_01_ingest_chunks")
