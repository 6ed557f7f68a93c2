"""Staging tables loaded run by run from landed JSON lines, and the fingerprint store."""

from __future__ import annotations

import datetime as dt
import gzip
import json

from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import fingerprint as fp
from tidemark.operators.activity import Activity, activity_metrics
from tidemark.operators.incremental import manifest, read_target
from tidemark.operators.quality import Unique, repeated_values, run_checks
from tidemark.plans.incremental_staging import stage_increment, unread_records
from tidemark.plans.repository_activity import stage_branches
from tidemark.sources import sinks
from tidemark.sources.readers import read_landing
from tidemark.sources.sinks import write_landing

LANDED = "data string, _sdc_extracted_at timestamp, _sdc_received_at timestamp, _sdc_batched_at timestamp, _sdc_deleted_at timestamp, _sdc_sequence bigint, _sdc_table_version bigint"


def record(name, sha, at, sequence=0, org="o"):
    payload = {"org": org, "repo": "r", "repo_id": 1, "name": name, "protected": True, "commit": {"sha": sha, "url": "u"}}
    return (json.dumps(payload), at, at, at, None, sequence, 1)


def at(micros):
    return dt.datetime(2024, 2, 1, 0, 0, 0, micros, tzinfo=dt.timezone.utc)


def test_a_run_reads_only_what_is_above_the_mark(spark, tmp_path):
    landing, path = str(tmp_path / "landing"), str(tmp_path / "branches")
    write_landing(spark.createDataFrame([record("a", "1", at(1)), record("b", "1", at(2)), record(None, "1", at(2))], LANDED), landing)
    stage_increment(path, read_landing(spark, landing), "branches")
    # One microsecond later: landing keeps it and the mark lets it through.
    write_landing(spark.createDataFrame([record("b", "2", at(3)), record("c", "2", at(3))], LANDED), landing)
    unread = unread_records(path, read_landing(spark, landing))
    assert unread.count() == 2
    assert "PushedFilters: [IsNotNull(_sdc_extracted_at), GreaterThan(_sdc_extracted_at" in plan(unread)
    stage_increment(path, read_landing(spark, landing), "branches")
    expected = [("a", "1"), ("b", "2"), ("c", "2")]
    assert rows(read_target(spark, path).select("branch_name", "commit_sha"), "branch_name") == expected
    version = manifest(spark, path)["version"]
    stage_increment(path, read_landing(spark, landing), "branches")  # nothing new
    assert manifest(spark, path)["version"] == version
    assert rows(read_target(spark, path).select("branch_name", "commit_sha"), "branch_name") == expected
    stage_increment(path, read_landing(spark, landing), "branches", full_refresh=True)
    assert rows(read_target(spark, path).select("branch_name", "commit_sha"), "branch_name") == expected


def test_records_extracted_at_once_are_told_apart_by_sequence(spark):
    data = [record("a", str(i), at(1), sequence=i) for i in range(50)]
    for parts in (1, 7):
        landed = spark.createDataFrame(data, LANDED).repartition(parts)
        assert rows(stage_branches(landed).select("commit_sha")) == [("49",)]
    same = [record("a", str(i), at(1)) for i in range(50)]
    picked = {rows(stage_branches(spark.createDataFrame(x, LANDED).repartition(5)).select("commit_sha"))[0] for x in (same, same[::-1])}
    assert len(picked) == 1


def test_distincts_and_modes_keep_their_types(spark):
    moment = dt.datetime(2024, 1, 1)
    data = [(1, moment, v, n) for v, n in [(0.0, 10), (-0.0, 10), (9.0, 9), (10.0, 9), (None, None)]]
    df = spark.createDataFrame(data, "actor bigint, ts timestamp_ntz, x double, n int")
    spec = Activity("actor", "ts", distincts={"xs": F.col("x"), "days": F.col("ts")}, modes={"x": F.col("x"), "n": F.col("n"), "at": F.col("ts")})
    found = activity_metrics(df, spec, F.lit(moment).cast("timestamp_ntz"))
    assert {f.name: f.dataType.simpleString() for f in found.schema if f.name in ("x", "n", "at")} == {"x": "double", "n": "int", "at": "timestamp_ntz"}
    # 9 and 10 occur twice each: the smaller number, not the smaller text.
    assert rows(found.select("xs", "days", "x", "n", "at")) == [(3, 1, 0.0, 9, moment)]


def test_texts_are_counted_by_digest(spark):
    long = "x" * 40
    digest = rows(spark.sql(f"SELECT sha2('{long}', 256)"))[0][0]
    data = [(long,), (long,), (digest,), ("a",), ("a",), ("b",), ("",), (None,), (None,), (long + "y",)]
    df = spark.createDataFrame(data, "text string")
    assert rows(repeated_values(df, "text"), "text") == [("a", 2), (long, 2)]
    assert run_checks({"t": df}, [Unique("t", "text")]).first()["failures"] == 2


def test_fingerprint_store(spark, tmp_path):
    path = str(tmp_path / "prints")

    def prints(*found):
        return spark.createDataFrame(found, "name string, schema_hash string, documentation_hash string, logic_hash string")

    def store(df, day):
        fp.store_fingerprints(path, df, "name", F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz"))
        return rows(fp.stored_fingerprints(spark, path).select("name", "schema_hash", F.dayofmonth("last_profiled_at")), "name")

    assert fp.stored_fingerprints(spark, path) is None
    assert store(prints(("a", "1", "1", "1"), ("b", "1", "1", "1"), (None, "1", "1", "1")), 1) == [("a", "1", 1), ("b", "1", 1)]
    assert store(prints(("a", "1", "1", "1"), ("b", "2", "1", "1"), ("c", "1", "1", "1")), 2) == [("a", "1", 1), ("b", "2", 2), ("c", "1", 2)]
    assert store(prints(("c", "1", "1", None)), 3) == [("a", "1", 1), ("b", "2", 2), ("c", "1", 3)]


def test_the_listed_columns_do_not_depend_on_order(spark):
    kind = "array<struct<name: string, description: string>>"
    data = [([("a", "x"), ("b", None)], [("b", None), ("a", "x")], [("ax", ""), ("b", None)])]
    df = spark.createDataFrame(data, f"p {kind}, q {kind}, r {kind}")
    (found,) = rows(df.select(*[fp.listed_columns(F.col(c)) for c in "pqr"]))
    assert found[0] == found[1] != found[2]


def test_landed_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    monkeypatch.setattr(sinks, "LANDED_PER_FILE", 100)
    data = [record(f"branch-{k}", str(k), at(k)) for k in range(950)]
    write_landing(spark.createDataFrame(data, LANDED).coalesce(1), str(landing))
    files = [gzip.decompress(f.read_bytes()).splitlines() for f in landing.glob("*.json.gz")]
    assert sorted(map(len, files)) == [50, *[100] * 9]
    assert sum(f.stat().st_size for f in landing.glob("part-*")) < 0.2 * sum(len(line) + 1 for lines in files for line in lines)
    assert sorted(rows(read_landing(spark, str(landing)).select("data", "_sdc_extracted_at"))) == sorted((r[0], r[1].replace(tzinfo=None)) for r in data)
