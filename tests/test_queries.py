"""Every registered query against its SQL; no plan may pair all rows or leave the JVM."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from oracle import compare, connect

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry  # noqa: E402
from tidemark.checks import load  # noqa: E402

QUERIES, SQL = load()

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    result = compare(spark, connection, FOLDER, name, QUERIES[name], SQL.get(name))
    assert result["problems"] == []
    assert result["rows"] > 0


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns == entry(spark).columns
