"""Key ranges of a stored table: sorted pieces with lower bounds and Bloom filters, so that a batch touches few of them.

Ranges stand in key order; range 0 has no lower bound, every other one starts at its own. The rows
of a batch find their ranges by comparing with the bounds if these are few, else in one global order together
with them: no row is compared with many, however many ranges there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_rank, running_total

RANGE = "_key_range"
_BOUND, _RANK, _PIECE = "_bound", "_rank", "_piece"

# Bits and hashes of a Bloom filter per key: about one key in a hundred looks present that is not.
BITS_PER_KEY = 10
HASHES = 4
# Fixed by the bitmap functions: bits of one bitmap.
BITMAP_BITS = 32768
# Bounds that a row is compared with one by one; beyond that number rows are put in one order with the bounds.
FEW_BOUNDS = 64
# Rows that one task sorts and writes: a range is written by several tasks.
WRITTEN_PER_TASK = 250_000


def compare_ranges(rows: DataFrame, keys: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``rows`` with the number of their range, by comparing each with every bound: for FEW_BOUNDS at most, as they come, in one pass."""
    lows = bounds.agg(F.collect_list(F.struct(*keys)).alias("_lows"))
    key = F.struct(*keys)
    return rows.join(F.broadcast(lows)).withColumn(RANGE, F.size(F.filter("_lows", lambda low: low <= key)).cast("bigint")).drop("_lows")


def assign_ranges(rows: DataFrame, keys: Sequence[str], bounds: DataFrame | None, count: int) -> DataFrame:
    """``rows`` (``count`` of them, plus bounds) with the number of their range.

    A row's range is the number of lower bounds at or before its key; ``bounds`` holds the
    key columns of all ranges but the first.
    """
    if bounds is None:
        return rows.withColumn(RANGE, F.lit(0).cast("bigint"))
    marked = rows.withColumn(_BOUND, F.lit(0).cast("bigint"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in keys]
    both = marked.unionByName(bounds.select(*keys, *missing, F.lit(1).cast("bigint").alias(_BOUND)))
    ranked = global_rank(both, [*(F.asc(k) for k in keys), F.desc(_BOUND)], _RANK, count)
    return running_total(ranked, _RANK, _BOUND, RANGE).where(f"{_BOUND} = 0").drop(_BOUND, _RANK)


def cut_ranges(rows: DataFrame, keys: Sequence[str], pieces: dict[int, int], rows_per_range: int, count: int) -> DataFrame:
    """Rows with ``_key_range``, sorted by it and by key, and ``_piece``: ranges named in ``pieces`` are cut into that many."""
    ordered = [F.asc(RANGE), *(F.asc(k) for k in keys)]
    if not pieces:
        tasks = max(1, -(-count // min(rows_per_range, WRITTEN_PER_TASK)))
        return rows.repartitionByRange(tasks, *ordered).sortWithinPartitions(*ordered).withColumn(_PIECE, F.lit(0).cast("bigint"))
    ranked = global_rank(rows, ordered, _RANK, count, min(rows_per_range, WRITTEN_PER_TASK))
    firsts = ranked.where(F.col(RANGE).isin(*pieces)).groupBy(RANGE).agg(F.min(_RANK).alias("_first"))
    sizes = rows.sparkSession.createDataFrame(sorted(pieces.items()), f"{RANGE} bigint, _pieces bigint")
    # One row per range that is cut.
    known = ranked.join(F.broadcast(firsts.join(sizes, RANGE)), RANGE, "left")
    piece = F.least(F.floor((F.col(_RANK) - F.col("_first")) / rows_per_range), F.col("_pieces") - 1)
    return known.withColumn(_PIECE, F.coalesce(piece, F.lit(0).cast("bigint"))).drop("_first", "_pieces", _RANK)


def bitmaps_needed(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_KEY // BITMAP_BITS))


def _bits(keys: Sequence[str], bitmaps: Column) -> Column:
    """A key's places in a filter of so many bitmaps, from 1."""
    hashed = [F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), bitmaps * BITMAP_BITS) + 1 for i in range(HASHES)]
    return F.explode(F.array(*hashed))


def bloom_filters(rows: DataFrame, keys: Sequence[str], owner: str, bitmaps: str) -> DataFrame:
    """(owner, bitmap, bits): the filters of all owners' keys, combined before their exchange."""
    places = rows.select(owner, _bits(keys, F.col(bitmaps)).alias("_bit"))
    numbered = places.select(owner, F.bitmap_bucket_number("_bit").alias("bitmap"), F.bitmap_bit_position("_bit").alias("_bit"))
    return numbered.groupBy(owner, "bitmap").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def may_hold(rows: DataFrame, keys: Sequence[str], filters: DataFrame, owner: str, bitmaps: str) -> DataFrame:
    """Distinct owners whose filters hold every place of at least one of the rows' keys."""
    places = rows.select(owner, *keys, _bits(keys, F.col(bitmaps)).alias("_bit"))
    place = F.bitmap_bit_position("_bit")
    probed = places.select(owner, *keys, F.bitmap_bucket_number("_bit").alias("bitmap"), place.alias("_at")).join(filters, [owner, "bitmap"])
    byte = F.conv(F.hex(F.substring("bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) > 0
    found = probed.select(owner, *keys, is_set.alias("_set")).groupBy(owner, *keys).agg(F.count_if("_set").alias("_n"))
    return found.where(F.col("_n") == HASHES).select(owner).distinct()
