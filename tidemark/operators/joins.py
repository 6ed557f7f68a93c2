"""Key-set joins, look-ups and snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# At most this many keys are treated as hot: the largest ones.
HOT_KEYS = 1000
# A key with fewer rows needs no care.
HOT_ROWS = 10_000_000
# Keys that a task's sketch keeps: counts are off by four rows in this many at most.
HOT_TRACKED = 65_536
# Pieces a hot key is split into.
SALTS = 64

_SALT = "_salt"


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys that hold more than ``rows`` rows, by default ``HOT_ROWS``; runs a job over the key column alone.

    Each task counts frequent keys in a sketch of bounded size, and sketches are merged: no row is
    shuffled, and no such key is missed while ``rows`` exceeds a sketch's error.
    The list only routes rows in ``spread_join``; no result depends on it.
    """
    sketch = F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {HOT_TRACKED})")
    found = df.where(F.col(key).isNotNull()).agg(sketch.alias("top")).first()["top"]
    return [item["item"] for item in found or [] if item["count"] > (HOT_ROWS if rows is None else rows)]


def spread_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot: Sequence | None = None, salts: int = SALTS
) -> DataFrame:
    """Left, semi or anti join with a ``lookup`` that holds each key at most once.

    Rows of a hot key are spread over ``salts`` tasks by a hash of the whole row
    and of the input partition, which tells copies of a row apart and is the same
    when a task runs again; the lookup's row of that key is repeated for each.
    NULL keys, which match nothing, are spread as well.  Hot keys are those the
    caller names, by knowledge or by ``hot_keys``; skew of any other key is left to
    adaptive execution, which splits large partitions of ``rows``.  No job runs
    while the join is built.
    """
    hot = list(hot or ())
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id())
    piece = F.pmod(hashed, F.lit(salts).cast("bigint")).cast("int")
    salted = rows.withColumn(_SALT, F.when(F.col(key).isNull() | is_hot, piece).otherwise(F.lit(0)))
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.withColumn(_SALT, F.explode(pieces) if hot else F.lit(0))
    return salted.join(repeated, [key, _SALT], how).drop(_SALT)


def include_exclude(
    df: DataFrame, key: str, include: DataFrame | None, exclude: DataFrame | None, hot: Sequence | None = None
) -> DataFrame:
    """Rows whose key is in ``include`` (if given) and not in ``exclude`` (if given)."""
    if include is not None:
        df = spread_join(df, include.select(key).distinct(), key, "left_semi", hot)
    if exclude is not None:
        df = spread_join(df, exclude.select(key).distinct(), key, "left_anti", hot)
    return df


def orphan_keys(child: DataFrame, foreign_key: str, parent: DataFrame, primary_key: str) -> DataFrame:
    """Non-null foreign keys without a parent, with their number of child rows.

    Children are counted per key before the join, so a key that holds a large
    share of the child table crosses the network as one row per map task.
    """
    keys = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count("*").alias("n_rows"))
    parents = parent.select(F.col(primary_key).alias(foreign_key)).distinct()
    return keys.join(parents, foreign_key, "left_anti")


def lookup_by_any_name(
    asked: DataFrame, asked_name: str, nodes: DataFrame, names: Sequence[str], node_id: str, hot: Sequence | None = None
) -> DataFrame:
    """Nodes whose name or alias equals the asked name, as one equi-join.

    An OR of two equalities would be a nested-loop join; each node is listed
    under every name it answers to instead.  A name that several nodes answer to
    goes to the lowest node id.
    """
    aliases = F.explode(F.array_distinct(F.array_compact(F.array(*names))))
    listed = nodes.select(aliases.alias(asked_name), F.struct(node_id, *[c for c in nodes.columns if c != node_id]).alias("_node"))
    best = listed.groupBy(asked_name).agg(F.min_by("_node", F.col(f"_node.{node_id}")).alias("_node"))
    return spread_join(asked, best, asked_name, hot=hot).select(*asked.columns, *[F.col(f"_node.{c}").alias(c) for c in nodes.columns])


def resolve_edges(
    edges: DataFrame, target: str, nodes: DataFrame, node_id: str, name: str, missing: Column | None = None, hot: Sequence | None = None
) -> DataFrame:
    """Replace an edge's target id by the node's name; a dangling id stays as it is.

    ``missing`` gives another text for dangling targets, such as ``unknown``.
    """
    named = nodes.select(F.col(node_id).alias(target), F.col(name).alias("_name"))
    fallback = F.col(target) if missing is None else missing
    joined = spread_join(edges, named, target, hot=hot)
    return joined.withColumn(target, F.coalesce("_name", fallback)).drop("_name").select(*edges.columns)


def column_lookup(stats: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column statistics with their descriptions, NULL where none is given."""
    return stats.join(docs, list(keys), "left")
