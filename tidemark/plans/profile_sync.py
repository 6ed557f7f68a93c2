"""One run that brings profiles and pages up to date: only tables whose fingerprints changed are read."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fingerprint import detect_changes, doc_fingerprint, listed_columns, schema_fingerprint, stored_fingerprints, text_fingerprint
from tidemark.operators.incremental import upsert
from tidemark.operators.profile import profile_tables, table_profile
from tidemark.sources.catalog import column_inventory
from tidemark.sources.sinks import render_profiles, write_documents


def table_fingerprints(spark: SparkSession, tables: Mapping[str, DataFrame], logic: DataFrame | None = None) -> DataFrame:
    """(table_name, schema_hash, documentation_hash, logic_hash) from schemas alone and the code texts of ``logic`` (table_name, text).

    A table without a text has the hash of an empty one.
    """
    inventory = column_inventory(spark, tables)
    described = inventory.groupBy("table_name").agg(F.collect_list(F.struct(F.col("column_name").alias("name"), "description")).alias("_columns"))
    texts = spark.createDataFrame([], "table_name string, text string") if logic is None else logic.select("table_name", "text")
    return (
        schema_fingerprint(inventory)
        .join(described, "table_name")
        .join(texts, "table_name", "left")
        .select(
            "table_name", "schema_hash", doc_fingerprint(F.lit(None), listed_columns(F.col("_columns"))).alias("documentation_hash"),
            text_fingerprint(F.coalesce("text", F.lit(""))).alias("logic_hash"),
        )
    )


def sync_profiles(
    spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]], store: str, out: str, profiled_at: Column, logic: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """Profiles new and changed tables, writes their pages, and stores their fingerprints.

    ``out`` gets ``profiles`` and ``pages``, a folder per table; those of unchanged tables are not touched, nor are the tables read.
    A table that fails keeps its old fingerprints, so it stays due. ``force`` profiles all. Returns one row per table now or before:
    the flags of ``detect_changes``, and ``status`` of what was profiled. What is collected are names of tables.
    """
    opened, broken = {}, {}
    for name, open_table in tables.items():
        try:
            opened[name] = open_table()
        except Exception as problem:  # the log keeps it; the other tables go on
            broken[name] = f"{type(problem).__name__}: {problem}"
    current = table_fingerprints(spark, opened, logic)
    cached = stored_fingerprints(spark, store)
    changes = detect_changes(current, current.limit(0) if cached is None else cached, "table_name")
    flags = spark.createDataFrame(changes.collect(), changes.schema)
    due = sorted(r["table_name"] for r in flags.where("NOT is_removed").collect() if force or r["should_reprofile"])
    log = profile_tables(spark, {name: lambda name=name: opened[name] for name in due}, f"{out}/profiles").collect()
    done = [r["table_name"] for r in log if r["status"] == "successful"]
    if done:
        columns = spark.read.parquet(*(f"{out}/profiles/table={name}" for name in done))
        write_documents(render_profiles(columns, table_profile(columns)), f"{out}/pages", keep_others=True)
        profiled = current.where(F.col("table_name").isin(done))
        upsert(store, profiled.withColumn("last_profiled_at", profiled_at), "table_name")
    status = [(r["table_name"], r["status"], r["error"]) for r in log] + [(name, "failed", error) for name, error in broken.items()]
    # A table that could not be opened is not one that was removed.
    outcome = spark.createDataFrame(status, "table_name string, status string, error string")
    kept = flags.where(~F.col("is_removed") | ~F.col("table_name").isin(list(broken)))
    return kept.join(outcome, "table_name", "full_outer")
