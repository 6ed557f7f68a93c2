"""Fingerprints of schemas, texts and descriptions, and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normalise_sql
from tidemark.operators.incremental import read_target, upsert

HASHES = ("schema_hash", "documentation_hash", "logic_hash")


def schema_fingerprint(inventory: DataFrame) -> DataFrame:
    """SHA-256 per table over its columns' (name, type, nullable), in column order.

    The list that is collected is a table's columns, which a schema bounds.
    """
    entry = F.struct(
        "ordinal",
        F.concat_ws(":", "column_name", "data_type", F.col("nullable").cast("string")).alias("text"),
    )
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"])
    return inventory.groupBy("table_name").agg(F.sha2(F.array_join(listed, "|"), 256).alias("schema_hash"))


def text_fingerprint(text: Column) -> Column:
    """SHA-256 of a code text; comments, case and spacing do not count."""
    return F.sha2(normalise_sql(text), 256)


def doc_fingerprint(description: Column, *details: Column) -> Column:
    """SHA-256 of a description and its details; missing parts count as empty."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in (description, *details)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def listed_columns(columns: Column) -> Column:
    """The columns of a documentation as one text, for ``doc_fingerprint``.

    ``columns`` is an array of (name, description) structs; their order does not count, NULL
    descriptions count as empty ones, and separators keep names and descriptions apart.
    """
    lines = F.transform(columns, lambda c: F.concat(c["name"], F.lit("\x1e"), F.coalesce(c["description"], F.lit(""))))
    return F.array_join(F.array_sort(lines), "\x1d")


def detect_changes(
    current: DataFrame, cached: DataFrame, key: str, hashes: Sequence[str] = HASHES
) -> DataFrame:
    """Current against cached fingerprints, one row per key of either side.

    A new key counts as changed in every respect; a removed one in none.
    """
    was = cached.select(F.col(key), *[F.col(h).alias(f"_was_{h}") for h in hashes], F.lit(True).alias("_cached"))
    now = current.select(key, *hashes, F.lit(True).alias("_current"))
    both = now.join(was, key, "full_outer")
    is_new = F.col("_cached").isNull()
    is_removed = F.col("_current").isNull()
    changed = {
        f"{h.removesuffix('_hash')}_changed": ~is_removed & (is_new | ~F.col(h).eqNullSafe(F.col(f"_was_{h}")))
        for h in hashes
    }
    flags = both.select(key, is_new.alias("is_new"), is_removed.alias("is_removed"), *[c.alias(n) for n, c in changed.items()])
    again = F.col(next(iter(changed)))
    for name in list(changed)[1:]:
        again = again | F.col(name)
    return flags.withColumn("should_reprofile", again)


def store_fingerprints(path: str, current: DataFrame, key: str, profiled_at: Column, hashes: Sequence[str] = HASHES) -> DataFrame:
    """Keep the fingerprints of what was profiled anew, and give the changes that called for it.

    ``current`` holds the key, the hashes and further details (such as the table profiled). Rows that are new or
    changed are upserted with ``profiled_at`` as their last-profiled time; unchanged ones keep theirs,
    and so do removed ones. Rows without a key are left out. The changes are those against the
    store as it was before.
    """
    spark = current.sparkSession
    current = current.dropna(subset=[key])
    cached = read_target(spark, path)
    changes = detect_changes(current, current.limit(0) if cached is None else cached, key, hashes)
    anew = changes.where("should_reprofile").select(key)
    upsert(path, current.join(anew, key, "left_semi").withColumn("last_profiled_at", profiled_at), key)
    return changes


def stored_fingerprints(spark: SparkSession, path: str) -> DataFrame | None:
    """Fingerprints with their last-profiled time; None before the first are stored."""
    return read_target(spark, path)
