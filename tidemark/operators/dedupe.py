"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_RANK = "_row_rank"


def top_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key.

    The rank filter becomes a WindowGroupLimit below the exchange: each map task
    forwards at most ``k`` rows of a key, so a key holding a third of the table
    still sends only a few rows per task to the reducer.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(ROW_RANK, F.row_number().over(window))
    return ranked.filter(F.col(ROW_RANK) <= k)


def latest_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.  Descending columns put NULL last.

    NULL keys form a group of their own, as GROUP BY would have it.
    """
    return top_rows(df, keys, order, 1).drop(ROW_RANK)
