"""The text corpus query: files grow with bytes, not with the number of texts."""

from __future__ import annotations

from conftest import rows

from tidemark.checks import loading
from tidemark.checks.registry import Tables


def test_many_texts_share_files(spark, tmp_path, monkeypatch):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    docs = [(i, "t", "en", "a" if i % 3 else "b", 1) for i in range(4000)] + [(None, "t", "en", "a", 1), (7, "t", None, "a", 1)]
    spark.createDataFrame(docs, schema).coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(loading, "scratch_path", lambda spark, label: str(tmp_path / label))
    got = rows(loading._text_corpus(Tables(spark, str(tmp_path))), "path")
    assert got == [(None, 1, 1), ("a/en", 500, 2667), ("b/en", 500, 1334)]
    assert len(list((tmp_path / "texts").rglob("*.txt"))) <= 12
