"""Global order over aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# Rows of a range at most; a smaller table is split over the session's partitions.
ROWS_PER_RANGE = 1_000_000

# Rows of a block whose values one task adds up.
BLOCK_BITS = 16

_POSITION = "_position"
_RANGE = "_range"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row within its partition there


def global_rank(
    df: DataFrame, order: Sequence[Column], name: str, rows: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """1-based position of every row in a total ``order`` (end it with a unique key).

    ``rows`` is the table's row count.  The table is range-sorted, each range
    numbers its own rows, and the sizes of the ranges before it are added: no
    task sees more than its range.  The sorted table is written to the
    checkpoint folder first, because counting and numbering have to see the same
    range bounds.  The offsets are one row per range, hence the broadcast.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / rows_per_range))
    in_order = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(in_order.withColumn(_POSITION, F.monotonically_increasing_id()))
    ranged = ranged.withColumn(_RANGE, F.shiftright(_POSITION, _LOCAL_BITS))

    sizes = ranged.groupBy(_RANGE).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(_RANGE, F.coalesce(before, F.lit(0)).alias("_before"))

    local = F.col(_POSITION).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranged.join(F.broadcast(offsets), _RANGE)
        .withColumn(name, F.col("_before") + local + 1)
        .drop(_RANGE, _POSITION, "_before")
    )


def running_total(ranked: DataFrame, rank: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of a dense ``rank`` up to each row, in the order of the rank.

    Values are added up within blocks of the order, and block sums over blocks: no task holds more than a block,
    but for one row per block.
    """
    blocked = ranked.withColumn("_block", F.shiftright(rank, BLOCK_BITS))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = sums.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_block").orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow))
    return blocked.withColumn("_within", within).join(blocks, "_block").withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows in order: TakeOrderedAndProject, k rows per task."""
    return df.orderBy(*order).limit(k)
