"""The registered queries run over whole tables; those with SQL equal it."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from samples import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import close, connect, rows_of  # noqa: E402

from tidemark.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    connection = connect(SMALL)
    source = {"op5": "embeddings", "op12": "embeddings", "op13": "conversations"}.get(name.split("_")[0], "documents")
    rows = connection.sql(f"SELECT count({'DISTINCT conv_id' if name.startswith('op13_') else '*'}) FROM {source}").fetchall()[0][0]
    rows = 4 * rows if name.startswith("op12_") else rows + 1 if name.startswith("op13_") else rows
    assert len(got) >= rows if name.startswith("op8_") else len(got) == rows
    if name in SQL:
        relation = connection.sql(SQL[name])
        want = rows_of(relation.columns, relation.fetchall())
        assert sorted(df.columns) == sorted(relation.columns)
        assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
