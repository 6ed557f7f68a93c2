"""Rows that all tests of the operators share, and their fixtures; no conftest, whose name the other tests import."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over a lazy dog while many small words follow one another in no great hurry . "
LONG = "".join(f"word{i % 977} and {i * i % 1009} more ; " for i in range(9000))

ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one", "en", "a", 3),
    (5, "two words", "en", "b", 9),
    (6, PROSE * 3, "en", "b", None),
    (7, PROSE * 3, "fr", "c", None),
    (7, PROSE * 3, "fr", "c", None),
    (7, "another text under the same id, with ünïcode   and \x00 in it", "fr", "a", None),
    (None, "a row without id", "en", "a", 16),
    (None, None, None, None, None),
    (8, LONG, "en", "b", None),
    (9, "x" * 5000, "en", "a", 5000),
    (10, "ab" * 3000, "en", "a", 6000),
    (11, PROSE.upper() + "中文" * 300, "zh", "\U0001f600", None),
    (12, LONG[:30000] + " tail", "en", "￿", None),
]


@pytest.fixture(scope="session")
def documents(spark):
    from tidemark.llm.common import table

    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Nulls, empty and very long texts, repeats, and further columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("id", "key", "fp", "size", "shard", "tie", "sig", "n_bytes", "score", "y", "n_tokens", "a", "octave")}
    return spark.createDataFrame(ODD, DOCS).repartition(3).withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts(df) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
