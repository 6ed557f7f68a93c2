"""Ratios, tiers and counting expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded quotient; NULL when the denominator is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0).cast("double") * F.try_divide(part.cast("double"), whole.cast("double")), digits)


def first_label(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds."""
    result = F
    for condition, name in rules:
        result = result.when(condition, F.lit(name))
    return result.otherwise(F.lit(default))


def count_where(condition: Column) -> Column:
    """Rows for which the condition is true; NULL counts as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
