from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.checks import repository as checks
from tidemark.operators.dedupe import latest_rows, top_rows
from tidemark.operators.flatten import flatten_payload, payload_schema
from tidemark.operators.quality import required_rows
from tidemark.plans import repository_activity as repo
from tidemark.plans import show_catalog
from tidemark.sources.readers import ENVELOPE

T0 = dt.datetime(2024, 1, 1)


def land(spark, *records):
    """(payload, hours) pairs as landed records, extracted that many hours after the start."""
    return spark.createDataFrame(
        [(json.dumps(p) if not isinstance(p, str) else p, T0 + dt.timedelta(hours=h), None, None, None, h, 1) for p, h in records],
        ENVELOPE,
    )


def test_latest_row_order_and_nulls(spark):
    df = spark.createDataFrame([("k", 1, 0, "a"), ("k", 3, 5, "b"), ("k", 3, 9, "c"), ("k", None, 99, "d"), (None, 1, 1, "e")],
                               "k string, t int, e int, x string")
    newest = latest_rows(df, ["k"], [F.desc("t"), F.desc("e")])
    assert sorted(r.x for r in newest.collect()) == ["c", "e"]
    assert plan(newest).split("== Initial Plan ==")[-1].count("WindowGroupLimit") == 2


def test_top_rows_of_a_dominant_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    top = top_rows(df, ["k"], [F.desc("id")], 2)
    assert top.where("k = 0").count() == 2
    assert top.groupBy("k").count().count() == df.select("k").distinct().count()


def test_flatten_kinds(spark):
    payload = {
        "s": "[WIP] {x", "list": [1], "obj": {"a": 1}, "q": "7", "n": 7, "f": 1.5, "t": "TRUE", "y": "yes", "null": None,
        "at": "2024-01-02T03:04:05Z", "in": {"deep": {"x": "{}"}}, "liststr": "[1]",
    }
    leaves = {
        "s": ("s", "text"), "list": ("list", "text"), "obj": ("obj", "text"), "obj_int": ("obj", "int"), "q": ("q", "int"),
        "n": ("n", "int"), "f": ("f", "int"), "f_text": ("f", "text"), "t": ("t", "bool"), "y": ("y", "bool"),
        "nul": ("null", "text"), "at": ("at", "timestamp"), "deep": ("in.deep.x", "text"), "liststr": ("liststr", "text"),
        "gone": ("gone", "text"), "gone_json": ("gone2", "json"),
    }
    row = flatten_payload(land(spark, (payload, 0)), leaves).first().asDict()
    assert row == {
        "s": "[WIP] {x", "list": None, "obj": None, "obj_int": None, "q": 7, "n": 7, "f": None, "f_text": "1.5", "t": True, "y": None,
        "nul": None, "at": dt.datetime(2024, 1, 2, 3, 4, 5), "deep": "{}", "liststr": "[1]", "gone": None, "gone_json": "null",
    }


def test_flatten_of_bad_payloads(spark):
    df = flatten_payload(land(spark, ("junk", 0), ("[]", 1)), {"a": ("a", "text"), "b": ("b.c", "int")}, keep=["_sdc_sequence"])
    assert rows(df, "_sdc_sequence") == [(0, None, None), (1, None, None)]


def test_schema_conflicts():
    with pytest.raises(ValueError):
        payload_schema(["a", "a.b"])
    with pytest.raises(ValueError):
        payload_schema(["a.b", "a"])


def test_flatten_parses_only_what_is_read(spark):
    df = flatten_payload(land(spark, ({"a": "x"}, 0)), {"a": ("a", "int"), "b": ("b", "int"), "c": ("c", "int")})
    assert plan(df.select("a")).count("StructField(") == 1


def commit(sha, at, message="m", **more):
    return {"sha": sha, "commit_timestamp": at, "commit": {"message": message, **more}}


def test_commits_newest_version_and_required_key(spark):
    landed = land(
        spark,
        (commit("a", "2024-01-01T00:00:00Z", "old"), 5),
        (commit("a", "2024-01-02T00:00:00Z", "newer time"), 1),
        (commit("b", "2024-01-02T00:00:00Z", "first"), 1),
        (commit("b", "2024-01-02T00:00:00Z", "second"), 2),
        (commit("c", None, "no time"), 9),
        (commit("c", "2024-01-01T23:30:00-02:00", "FIX:x #12"), 1),
        (commit(None, "2024-01-02T00:00:00Z"), 3),
    )
    staged = repo.stage_commits(landed)
    got = rows(staged.select("sha", "commit_message", "commit_type", "pull_request_number", F.col("commit_date").cast("string"), "commit_hour"), "sha")
    assert got == [
        ("a", "newer time", "other", None, "2024-01-02", 0),
        ("b", "second", "other", None, "2024-01-02", 0),
        ("c", "FIX:x #12", "fix", 12, "2024-01-02", 1),
    ]


def test_merge_flag(spark):
    def pair(a, b):
        return {"author": {"email": a}, "committer": {"email": b}}

    landed = land(spark, *[(commit(str(i), None, **pair(a, b)), i) for i, (a, b) in enumerate([("x", "x"), ("x", "y"), ("x", None), (None, None)])])
    got = rows(repo.stage_commits(landed).select("sha", "is_merge_commit"), "sha")
    assert [flag for _, flag in got] == [False, True, False, False]


def test_branches(spark):
    base = {"org": "o", "repo": "r", "repo_id": 1, "name": "main"}
    landed = land(spark, (base | {"protected": "true"}, 1), (base | {"protected": False}, 2), (base | {"repo_id": None}, 1),
                  (base | {"name": None}, 1), (base | {"org": None}, 1))
    got = rows(repo.branches_mart(repo.stage_branches(landed)).select("branch_sk", "is_protected", "is_main_branch", "full_repo_name"), "branch_sk")
    assert got == [("o/r:1:main", False, True, "o/r"), ("o/r::main", None, True, "o/r")]


def test_repositories_key_fallback_and_name_filter(spark):
    landed = land(
        spark,
        ({"id": 1, "org": "o", "name": "n", "full_name": "o/n"}, 1),
        ({"id": 2, "org": "o", "repo": "slug"}, 1),
        ({"id": 3, "org": "o", "name": "", "repo": "slug"}, 1),
        ({"id": 4, "org": "o"}, 1),
        ({"id": 5, "name": "n"}, 1),
        ({"id": 1, "org": "o", "name": "older", "updated_at": None, "created_at": None}, 0),
    )
    got = rows(repo.stage_repositories(landed).select("repo_id", "repo_sk", "repo", "full_repo_name", "owner_is_site_admin"), "repo_id")
    assert got == [(1, "1:o/n", "n", "o/n", False), (2, "2:o", "slug", "o/slug", False)]


def test_mart_columns(spark):
    empty = spark.createDataFrame([], ENVELOPE)
    assert len(repo.commits_mart(repo.stage_commits(empty)).columns) == 43
    assert len(repo.request_commits_mart(repo.stage_request_commits(empty)).columns) == 47
    assert len(repo.branches_mart(repo.stage_branches(empty)).columns) == 12
    assert len(repo.repositories_mart(repo.stage_repositories(empty)).columns) == 38
    assert len(repo.committers_mart(repo.stage_commits(empty)).columns) == 55


def test_required_rows(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", ""), ("c", None)], "k string, n string")
    assert rows(required_rows(df, ["k"], ["n"])) == [("a", "x")]


def test_strict_catalog_casts(spark):
    landed = spark.createDataFrame([("x", "n", "d", "e", "u", "2017-01-01T00:00:00Z", None)],
                                   "id string, name string, air_date string, episode string, url string, created string, characters string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        show_catalog.stage_episodes(landed).collect()


def test_each_staged_payload_is_parsed_twice_at_most(spark):
    """Once for its key, once for the rest: a filter on a leaf is not moved below the parser, where it would parse again."""
    staged = repo.stage_commits(land(spark, ({"sha": "a", "commit_timestamp": "2024-01-01T00:00:00Z"}, 0), ({"sha": None}, 1)))
    final = plan(staged).split("== Initial Plan ==")[-1]
    assert "isnotnull(from_json" not in final and not re.search(r"Filter [^\n]*from_json", final)
    assert [r["sha"] for r in staged.collect()] == ["a"]


def test_landed_records_are_dealt_evenly(spark, monkeypatch):
    """However few files a table has, a task makes a bounded number of payloads."""
    monkeypatch.setattr(checks, "LANDED_PER_TASK", 100, raising=False)
    landed = checks.land(spark.range(1000).coalesce(1), id=F.col("id"))
    sizes = [r["count"] for r in landed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 2000 and max(sizes) <= 400
