"""Snapshots, samples, statistics of files, and the run that brings profiles up to date."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import profile as pr
from tidemark.operators import snapshot as sn
from tidemark.operators.fingerprint import stored_fingerprints
from tidemark.plans.profile_sync import sync_profiles
from tidemark.session import path_exists, scratch_path
from tidemark.sources.readers import sample_n

DDL = "a int, b string, v double, w string"


def snapshot(spark, data, ddl=DDL, key=("a", "b"), bits=5):
    path = scratch_path(spark, "snapshot")
    sn.write_snapshot(spark.createDataFrame(data, ddl).repartition(3), path, list(key), bits)
    return path


def test_only_differing_ranges_are_read(spark):
    old = [(i, "k", float(i), None) for i in range(400)]
    new = [r for r in old if r[0] != 7] + [(1000, "k", 0.0, "new")]
    new[50] = (new[50][0], "k", -1.0, None)
    paths = snapshot(spark, old), snapshot(spark, new)
    ranges = sn.changed_ranges(spark, *paths)
    assert 1 <= len(ranges) <= 3
    read = sn.read_ranges(spark, paths[0], ranges)
    assert read.count() < 100 and "PartitionFilters: [_hash_range" in plan(read).replace("isnotnull(_hash_range", "_hash_range")
    assert sorted(rows(sn.snapshot_changes(spark, *paths))) == [(7, "k", "removed"), (new[50][0], "k", "changed"), (1000, "k", "added")]


def test_equal_snapshots_in_any_layout(spark):
    data = [(i % 50, f"{i}", i / 3, None if i % 2 else "x") for i in range(200)]
    paths = snapshot(spark, data), snapshot(spark, data[::-1])
    assert sn.changed_ranges(spark, *paths) == [] and sn.snapshot_changes(spark, *paths).collect() == []


def test_nulls_that_change_places_are_changes(spark):
    paths = snapshot(spark, [(1, None, None, "x"), (None, "1", 1.0, None)]), snapshot(spark, [(1, None, None, "x"), (None, "1", None, "1.0")])
    assert rows(sn.snapshot_changes(spark, *paths)) == [(None, "1", "changed")]
    empty = snapshot(spark, [])
    assert sorted(r["change"] for r in sn.snapshot_changes(spark, empty, paths[0]).collect()) == ["added", "added"]
    assert sn.snapshot_changes(spark, empty, empty).count() == 0


def test_half_a_snapshot_is_refused(spark):
    path = snapshot(spark, [(1, "x", 1.0, "y")])
    with pytest.raises(ValueError, match="complete"):
        sn.changed_ranges(spark, path, scratch_path(spark, "nothing"))
    with pytest.raises(ValueError, match="one key"):
        sn.changed_ranges(spark, path, snapshot(spark, [(1, "x", 1.0, "y")], bits=4))


def test_sample_of_n(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("s"))
    one, two = (sorted(rows(sample_n(df.repartition(p), 100, ["id"]))) for p in (1, 9))
    assert one == two and len(one) == 100 and set(one) <= set(rows(sample_n(df, 300, ["id"])))
    assert sorted(rows(sample_n(df, 100, ["id"], seed=1))) != one
    assert 1900 < sum(i for i, _ in rows(sample_n(df, 2000, ["id"]))) / 2000 < 3100
    strata = sample_n(df.union(spark.createDataFrame([(9999, None)], df.schema)), 40, ["id"], by=["s"])
    assert sorted(rows(strata.groupBy("s").count()), key=str) == [(0, 40), (1, 40), (2, 40), (None, 1)]
    assert sample_n(df.limit(5), 100, ["id"]).count() == 5 and sample_n(df.limit(0), 5, ["id"]).count() == 0
    assert "TakeOrderedAndProject" in plan(sample_n(df, 100, ["id"]))


def test_footers_answer_for_whole_numbers(spark):
    path = scratch_path(spark, "footers")
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") - 500).cast("int").alias("n"), F.lit(None).cast("bigint").alias("none"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"), (F.col("id") / 3).alias("x"), F.col("id").cast("string").alias("s"),
    )
    df.repartition(4).write.parquet(path)
    stored = spark.read.parquet(path)
    want = sorted(rows(pr.column_basics(stored).select("ordinal", "column_name", "row_count", "null_count", "min_value", "max_value", "null_percentage")))
    assert sorted(rows(pr.stored_basics(spark, path).select("ordinal", "column_name", "row_count", "null_count", "min_value", "max_value", "null_percentage"))) == want
    assert not spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "true"
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        held = spark.read.parquet(path)
        asked = pr.footer_aggregate(held, [f for f in held.schema if isinstance(f.dataType, pr.IN_STATISTICS)])
        assert "agg_func" in plan(asked)  # the scan itself answers
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")


def test_sync_touches_what_changed_and_retries_what_failed(spark):
    store, out = scratch_path(spark, "store"), scratch_path(spark, "out")
    at = [F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in range(1, 5)]

    def broken():
        raise OSError("away")

    def files(name):
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        return [s.getModificationTime() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}"))]

    one, two = spark.range(3), spark.range(4).withColumn("s", F.lit("x"))
    first = sync_profiles(spark, {"one": lambda: one, "two": lambda: two, "three": broken}, store, out, at[0])
    assert sorted((r["table_name"], r["status"]) for r in first.collect()) == [("one", "successful"), ("three", "failed"), ("two", "successful")]
    before = files("profiles/table=one") + files("pages/schema_name=public/table_name=one")
    time.sleep(1)
    tables = {"one": lambda: one, "two": lambda: two.drop("s"), "three": lambda: one}
    second = sync_profiles(spark, tables, store, out, at[1])
    assert sorted((r["table_name"], r["is_new"], r["status"]) for r in second.collect()) == [("one", False, None), ("three", True, "successful"), ("two", False, "successful")]
    assert files("profiles/table=one") + files("pages/schema_name=public/table_name=one") == before
    third = sync_profiles(spark, {"two": tables["two"], "three": broken}, store, out, at[2])
    assert sorted((r["table_name"], r["is_removed"], r["status"]) for r in third.collect()) == [("one", True, None), ("three", None, "failed"), ("two", False, None)]
    assert [r["status"] for r in sync_profiles(spark, {"one": lambda: one}, store, out, at[3], force=True).where("table_name = 'one'").collect()] == ["successful"]
    days = dict(rows(stored_fingerprints(spark, store).select("table_name", F.dayofmonth("last_profiled_at"))))
    assert days == {"one": 4, "two": 2, "three": 2} and path_exists(spark, f"{out}/pages/schema_name=public/table_name=three")
