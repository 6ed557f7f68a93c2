"""Stored snapshots with a tree of digests: two of them are compared without reading what is equal.

Rows lie in ranges of a hash of their key. The digest of a range does not depend on the order of its
rows, and digests add up: a node of the tree is the sum of its children, up to one for the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import read_marker, write_marker

# Bits of the key's hash that name a range, and how many of them a level of the tree adds.
RANGE_BITS = 12
LEVEL_BITS = 4

_RANGE = "_hash_range"
_DIGEST = "level int, node bigint, n bigint, s1 decimal(38,0), s2 decimal(38,0)"


def _hash(columns: Sequence[str], seed: int) -> Column:
    # A hash skips nulls; their places are hashed beside the values.
    return F.xxhash64(F.lit(seed), *[c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())])


def write_snapshot(df: DataFrame, path: str, key: Sequence[str], range_bits: int = RANGE_BITS) -> None:
    """Writes a table, one folder per range, and its digests at all levels; ``key`` tells its rows apart.

    Complete once its marker is there; ``range_bits`` should make a range a file's worth.
    """
    place = F.shiftrightunsigned(_hash(key, 0), 64 - range_bits)
    rows = df.withColumn(_RANGE, place)
    rows.repartition(_RANGE).write.partitionBy(_RANGE).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    sums = [F.sum(_hash(df.columns, seed).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    leaves = stored.groupBy(F.col(_RANGE).alias("node")).agg(F.count("*").alias("n"), *sums)
    levels = [*range(0, range_bits, LEVEL_BITS), range_bits]
    nodes = leaves.select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "node", "n", "s1", "s2")
    up = nodes.groupBy("level", F.expr(f"shiftright(node, {range_bits} - level)").alias("node"))
    up.agg(*[F.sum(c).cast("bigint" if c == "n" else "decimal(38,0)").alias(c) for c in ("n", "s1", "s2")]).repartitionByRange("level", "node").write.parquet(f"{path}/digests")
    write_marker(df.sparkSession, f"{path}/_complete", json.dumps({"bits": range_bits, "key": list(key), "schema": rows.schema.jsonValue()}))


def _described(spark: SparkSession, path: str) -> dict:
    text = read_marker(spark, f"{path}/_complete")
    if text is None:
        raise ValueError(f"the snapshot at {path} is not complete")
    return json.loads(text)


def changed_ranges(spark: SparkSession, old: str, new: str) -> list[int]:
    """Ranges whose rows differ, found from the root of both trees down: below equal nodes nothing is read.

    A list of range numbers, bounded by how many ranges there are.
    """
    was, now = _described(spark, old), _described(spark, new)
    if (was["bits"], was["key"]) != (now["bits"], now["key"]):
        raise ValueError("both snapshots must be of one key and one number of ranges")
    bits = now["bits"]
    differing, above = [0], 0
    for level in [*range(0, bits, LEVEL_BITS), bits]:
        wanted = [node << (level - above) for node in differing]
        below = F.col("level") == level
        if level:
            below &= F.shiftright("node", level - above).isin(differing) & F.col("node").between(min(wanted), max(wanted) + (1 << (level - above)) - 1)
        sides = [spark.read.schema(_DIGEST).parquet(f"{p}/digests").where(below).select("node", F.struct("n", "s1", "s2").alias(side)) for p, side in ((old, "was"), (new, "now"))]
        met = sides[0].join(sides[1], "node", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        differing, above = sorted(r["node"] for r in met.select("node").collect()), level
        if not differing:
            break
    return differing


def read_ranges(spark: SparkSession, path: str, ranges: Sequence[int]) -> DataFrame:
    """The rows of some ranges; no other file is opened."""
    schema = T.StructType.fromJson(_described(spark, path)["schema"])
    return spark.read.schema(schema).parquet(f"{path}/rows").where(F.col(_RANGE).isin(list(ranges))).drop(_RANGE)


def snapshot_changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(key, change): keys that were ``added``, ``removed`` or ``changed`` in any column; only differing ranges are joined."""
    keys = _described(spark, new)["key"]
    ranges = changed_ranges(spark, old, new)
    was, now = (read_ranges(spark, p, ranges) for p in (old, new))
    columns = [c for c in now.columns if c not in keys]
    if sorted(was.columns) != sorted(now.columns):
        raise ValueError("the snapshots have other columns")
    sides = [side.select(*keys, F.struct(*columns, F.lit(True).alias("_there")).alias(name)) for side, name in ((was, "_was"), (now, "_now"))]
    same = [sides[0][k].eqNullSafe(sides[1][k]) for k in keys]
    both = sides[0].join(sides[1], same, "full_outer").where(~F.col("_was").eqNullSafe(F.col("_now")))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("changed")
    return both.select(*[F.coalesce(sides[0][k], sides[1][k]).alias(k) for k in keys], change.alias("change"))
