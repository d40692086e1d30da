from __future__ import annotations

import pytest

LONG = "the of and " * 40_000
ROWS = [
    (1, "one two three four five six seven eight", "en", "a", 39),
    (2, "one two three four five six seven eight", "en", "a", 39),   # a copy
    (2, "one two three four five six seven eight", "en", "a", 39),   # a repeated row
    (3, "", "en", "a", 0),
    (4, None, "en", None, None),
    (None, "an id that is null", None, "b", None),
    (5, " \n\t ", "de", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (6, "the same id with another text", "fr", "c", 29),
    (7, "A", "es", "c", 1),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, and columns that clash with results."""
    df = spark.createDataFrame(ROWS, SHAPE)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("size", "shard", "slot", "key", "h", "id", "kept", "score", "node", "_h")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
