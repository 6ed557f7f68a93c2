"""Keys and labels built from several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(parts: Sequence[str | Column], separators: Sequence[str]) -> Column:
    """Parts joined by one separator between each pair; a NULL part is empty text.

    ``concat_ws`` is no substitute: it drops the separator along with the NULL.
    """
    if len(separators) != len(parts) - 1:
        raise ValueError("need exactly one separator between two parts")
    texts = [
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts
    ]
    pieces = [texts[0]]
    for separator, text in zip(separators, texts[1:]):
        pieces += [F.lit(separator), text]
    return F.concat(*pieces)


def label(*parts: str | Column, separator: str = "/") -> Column:
    """``a/b``; NULL as soon as one part is NULL."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    pieces = [columns[0]]
    for column in columns[1:]:
        pieces += [F.lit(separator), column]
    return F.concat(*pieces)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def both_known_and_differ(a: Column, b: Column) -> Column:
    """False, never NULL, when either side is NULL."""
    return a.isNotNull() & b.isNotNull() & F.coalesce(a != b, F.lit(False))


def null_safe_greatest(*columns: Column) -> Column:
    """Greatest value, but NULL if any input is NULL (Spark's own skips NULLs)."""
    known = columns[0].isNotNull()
    for column in columns[1:]:
        known = known & column.isNotNull()
    return F.when(known, F.greatest(*columns))
