from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import activity_state as state
from tidemark.operators import aggregates as agg
from tidemark.operators import incremental as inc
from tidemark.operators.activity import Activity, activity_mart, activity_metrics
from tidemark.operators.ranking import global_rank
from tidemark.session import scratch_path

NOW = dt.datetime(2024, 6, 1, 12)
DDL = "actor bigint, ts timestamp_ntz, kind string, flag boolean, id bigint"


def spec() -> Activity:
    return Activity(
        actor="actor", ts="ts", noun="events",
        counts={"a_events": F.col("kind") == "a", "b_events": F.col("kind") == "b", "plain": ~F.coalesce("flag", F.lit(False)),
                "flagged": F.coalesce("flag", F.lit(False))},
        any_of={"ever": F.col("flag")},
        distincts={"kinds": F.col("kind")}, modes={"usual": F.col("kind")},
        latest={"last_kind": F.col("kind")}, latest_ties=[F.col("id")],
        percents={"a_pct": "a_events"},
    )


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


def random_rows(n=3000, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One actor owns a third of all rows.
        actor = 1 if rng.random() < 0.34 else rng.choice([None, *range(2, 40)])
        ts = None if rng.random() < 0.03 else NOW - dt.timedelta(seconds=rng.randint(0, 500 * 86400))
        out.append((actor, ts, rng.choice(["a", "b", "c", None]), rng.choice([True, False, None]), i))
    return out


def brute_force(data):
    groups: dict = {}
    for row in data:
        if row[0] is not None:
            groups.setdefault(row[0], []).append(row)
    result = {}
    for actor, rs in groups.items():
        dated = [r for r in rs if r[1] is not None]
        per_day = Counter(r[1].date() if r[1] else None for r in rs)
        hours = Counter(r[1].hour if r[1] else -1 for r in rs)
        days = Counter(r[1].isoweekday() % 7 + 1 if r[1] else -1 for r in rs)
        kinds = Counter(r[2] for r in rs if r[2])

        def mode(counter):
            best = min(counter.items(), key=lambda kv: (-kv[1], kv[0]))[0]
            return None if best == -1 else best

        def recent(n):
            return [r for r in dated if r[1] >= NOW - dt.timedelta(days=n)]

        newest = max(rs, key=lambda r: (r[1] is not None, r[1] or NOW, r[4]))
        first, last = (min(r[1] for r in dated), max(r[1] for r in dated)) if dated else (None, None)
        result[actor] = {
            "total_events": len(rs), "active_days": len(set(r[1].date() for r in dated)),
            "a_events": sum(r[2] == "a" for r in rs), "flagged": sum(r[3] is True for r in rs),
            "plain": sum(r[3] is not True for r in rs), "ever": any(r[3] for r in rs),
            "kinds": len(kinds), "usual": mode(kinds) if kinds else None, "last_kind": newest[2],
            "max_events_in_day": max(per_day.values()), "avg_events_per_active_day": len(rs) / len(per_day),
            "most_active_hour": mode(hours), "most_active_day_of_week": mode(days),
            "first_at": first, "last_at": last,
            "days_active_span": int((last - first).total_seconds() // 86400) if dated else None,
            "weekend_events": sum(r[1].isoweekday() in (6, 7) for r in dated),
            "weekday_events": sum(r[1].isoweekday() <= 5 for r in dated),
            "business_hours_events": sum(9 <= r[1].hour <= 17 for r in dated),
            "off_hours_events": sum(not 9 <= r[1].hour <= 17 for r in dated),
            **{f"events_last_{n}_days": len(recent(n)) for n in (30, 90, 180, 365)},
            **{f"active_days_last_{n}": len({r[1].date() for r in recent(n)}) for n in (30, 90, 365)},
        }
    return result


@pytest.fixture(scope="module")
def data():
    return random_rows()


@pytest.fixture(scope="module")
def mart(spark, data):
    df = spark.createDataFrame(data, DDL).repartition(6)
    # Ten actors per range, so that the ranks cross range borders.
    return activity_mart(df, spec(), as_of(), rows_per_range=10).collect()


def test_against_brute_force(mart, data):
    want = brute_force(data)
    got = {r["actor"]: r.asDict() for r in mart}
    assert got.keys() == want.keys()
    for actor, expected in want.items():
        for name, value in expected.items():
            found = got[actor][name]
            assert found == (pytest.approx(value) if isinstance(value, float) else value), (actor, name)


def test_invariants(mart):
    for r in mart:
        assert r.flagged + r.plain == r.total_events
        assert r.weekend_events + r.weekday_events == r.business_hours_events + r.off_hours_events
        assert r.events_last_30_days <= r.events_last_90_days <= r.events_last_365_days <= r.total_events
    for rank, metric in (("rank_by_total_events", "total_events"), ("rank_by_recent_activity", "events_last_90_days")):
        ordered = sorted(mart, key=lambda r: (-r[metric], r["actor"]))
        assert [r[rank] for r in ordered] == list(range(1, len(mart) + 1))


def test_tiers(spark):
    ages = {1: 29, 2: 60, 3: 120, 4: 300, 5: 400, 6: 30}
    df = spark.createDataFrame([(k, NOW - dt.timedelta(days=d), "a", None, k) for k, d in ages.items()], DDL)
    got = dict(rows(activity_metrics(df, spec(), as_of()).select("actor", "activity_status")))
    assert got == {1: "Very Active", 2: "Active", 3: "Moderately Active", 4: "Less Active", 5: "Inactive", 6: "Very Active"}


def test_span_of_one_day_counts_as_one(spark):
    df = spark.createDataFrame([(1, NOW, "a", None, i) for i in range(5)], DDL)
    row = activity_metrics(df, spec(), as_of()).first()
    assert (row.days_active_span, row.avg_events_per_day_in_span, row.days_since_last_event) == (0, 5.0, 0)


def test_actor_without_times(spark):
    df = spark.createDataFrame([(1, None, "a", None, 1)], DDL)
    row = activity_metrics(df, spec(), as_of()).first()
    assert (row.total_events, row.active_days, row.most_active_hour, row.events_per_active_day) == (1, 0, None, None)
    assert row.activity_status == "Inactive" and row.max_events_in_day == 1


def test_rows_are_combined_before_every_exchange(spark, data):
    df = spark.createDataFrame(data, DDL)
    text = plan(activity_metrics(df, Activity(actor="actor", ts="ts"), as_of())).split("== Initial Plan ==")[-1]
    # Rows by actor; days by actor and day, then by actor.
    assert text.count("Exchange hashpartitioning") == 3
    lines = text.splitlines()
    assert all("HashAggregate" in lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("rows_per_range", [1, 7, 1000])
def test_global_rank_in_any_number_of_ranges(spark, rows_per_range):
    # A third of all rows shares one metric value.
    data = [(i, 5 if i % 3 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(data, "k int, m int").repartition(5)
    ranked = global_rank(df, [F.desc("m"), F.asc("k")], "r", 200, rows_per_range)
    got = {r.k: r.r for r in ranked.collect()}
    ordered = sorted(data, key=lambda x: (-x[1], x[0]))
    assert [got[k] for k, _ in ordered] == list(range(1, 201))


def test_labelled_count_keeps_raw_groups(spark):
    df = spark.createDataFrame([("unknown",), (None,), ("A",)], "status string")
    assert sorted(rows(agg.labelled_count(df, "status", "unknown", "n"))) == [("A", 1), ("unknown", 1), ("unknown", 1)]


def test_group_mode_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, "x")], "k int, v string")
    assert rows(agg.group_mode(df, "k", "v", "m"), "k") == [(1, "a", 1), (2, "x", 1)]


def test_top_values(spark):
    df = spark.createDataFrame([(1, v) for v in "aabbcdee"] + [(1, None)], "k int, v string")
    assert rows(agg.top_values(df, "k", "v", 3), "value_rank") == [(1, "a", 2, 1), (1, "b", 2, 2), (1, "e", 2, 3)]


def test_distinct_counts_equal_plain_ones(spark):
    """Null keys, null values, conditions that never hold, negative numbers, days, instants, floats and texts of any length."""
    df = spark.sql(
        """SELECT IF(id % 7 = 0, NULL, id % 3) AS k, IF(id % 5 = 0, NULL, id * 37 % 191 - 90) AS n, date_add(DATE'1969-10-01', CAST(id * 11 % 150 AS INT)) AS d,
        timestamp_micros(id * 13 % 97 - 50) AS at, CAST(id % 11 AS DOUBLE) / IF(id % 11 = 0, IF(id % 2 = 0, -1, 1), 3) AS x, repeat('text', CAST(id % 13 AS INT)) AS s,
        CAST(id % 17 AS DECIMAL(9, 2)) AS c, id % 2 = 0 AS even FROM range(800) UNION ALL SELECT 9, NULL, NULL, NULL, NULL, NULL, NULL, true"""
    ).repartition(5)
    names = ["n", "d", "at", "x", "s", "c"]
    conditions = {"": F.lit(True), "_even": F.col("even"), "_never": F.lit(False), "_unknown": F.lit(None).cast("boolean")}
    got = agg.distinct_counts(df, ["k"], {n + c: (F.col(n), condition) for n in names for c, condition in conditions.items()} | {"plain": F.col("n")})
    want = df.groupBy("k").agg(*[F.count_distinct(F.when(condition, F.col(n))).alias(n + c) for n in names for c, condition in conditions.items()], F.count_distinct("n").alias("plain"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    assert "Expand" not in plan(got)


def test_states_add_up_to_the_mart(spark, monkeypatch):
    """Loads of any size, folded now and then, with late rows, ties, null actors, times and values, give the mart of all rows; nothing is read twice."""
    monkeypatch.setattr(state, "MOST_FOLDERS", 2)
    rng = random.Random(5)
    def moment():
        return None if rng.random() < 0.05 else NOW - dt.timedelta(days=rng.choice([0, 29, 30, 31, 89, 90, 91, 180, 365, 366, 400]), seconds=rng.choice([-1, 0, 1, 3600]))
    data = [(rng.choice([1, 1, 1, 2, 3, None]), moment(), rng.choice(["a", "b", None]), rng.random() < 0.3, i, i // 40) for i in range(200)]
    source = spark.createDataFrame(data, DDL + ", arrived int").repartition(4)
    a, path, as_of = spec(), scratch_path(spark, "states"), F.lit(NOW).cast("timestamp_ntz")
    for upto in (0, 2, 2, 3, 9):
        state.load_activity(path, source.where(F.col("arrived") <= upto), a, "arrived")
    assert inc.decode_mark(inc.manifest(spark, path)["mark"]) == 4 and len(inc.manifest(spark, path)["folders"]) <= 2
    got = state.stored_activity_mart(spark, path, source, a, as_of)
    want = activity_mart(source, a, as_of)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.count() == 3


def test_a_load_of_states_that_dies_counts_nothing(spark, monkeypatch):
    source, a, path = spark.createDataFrame([(1, NOW, "a", True, 1)], DDL), spec(), scratch_path(spark, "states")
    with monkeypatch.context() as m:
        m.setattr(state, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            state.load_activity(path, source, a, "id")
    for _ in range(2):
        state.load_activity(path, source, a, "id")
    assert [r[f"total_{a.noun}"] for r in state.stored_activity_mart(spark, path, source, a, F.lit(NOW)).collect()] == [1]
