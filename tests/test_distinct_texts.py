"""Long texts in distinct counts are held as bytes of a digest."""

from __future__ import annotations

from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators.aggregates import distinct_counts


def test_long_texts_cost_the_bytes_of_a_digest(spark):
    texts = ["a" * n for n in (1, 31, 32, 33, 400)] + ["é" * 16, "", None, "a" * 400]
    df = spark.createDataFrame([("k", t) for t in texts], "k string, t string")
    counted = distinct_counts(df, ["k"], {"n": F.col("t"), "long": (F.col("t"), F.length("t") > 31)})
    assert rows(counted) == [("k", 7, 3)]
    assert "unhex(sha2(" in plan(counted)
