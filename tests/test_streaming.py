from __future__ import annotations

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.session import scratch_path
from tidemark.streaming import state

DDL = "key int, event int, v string"


def run(spark, parts, folder):
    """Lands parts one by one, each taken by a run of its own, and gives the target after each."""
    source, target, offsets = (scratch_path(spark, f"{folder}-{n}") for n in ("source", "target", "offsets"))
    seen, emitted = [], []
    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        before = inc.manifest(spark, target)
        state.upsert_changes(state.newest_changes(state.read_stream(spark, source, DDL), "key", ["event"]), target, "key", offsets).awaitTermination()
        after = inc.manifest(spark, target)
        new = [d["name"] for d in after["deltas"] if before and d["name"] not in {b["name"] for b in before["deltas"]}]
        emitted.append(sorted(rows(spark.read.parquet(*(f"{target}/{n}" for n in new)).select("key", "event", "v"))) if new else [])
        seen.append(sorted(rows(inc.read_target(spark, target))))
    return seen, emitted


def test_newest_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(inc, "DELTA_PART", 100)  # nothing is folded, so that each run's changes can be seen
    early, late = [(1, 1, "a"), (2, 1, "a"), (None, 9, "z")], [(1, 2, "b"), (3, 2, "b"), (2, None, "n")]
    first, _ = run(spark, [early, late], "rising")
    second, emitted = run(spark, [late, early], "falling")
    assert first[-1] == second[-1] == [(1, 2, "b"), (2, 1, "a"), (3, 2, "b")]
    # The late row of key 1 emits nothing, the first time of key 2 does.
    assert emitted[1] == [(2, 1, "a")]


def test_ties_do_not_depend_on_the_order(spark):
    parts = [[(1, 1, v)] for v in "abc"]
    ends = {str(run(spark, [parts[i] for i in order], "ties")[0][-1]) for order in ((0, 1, 2), (2, 0, 1))}
    assert len(ends) == 1


def test_windows_give_up_their_state(spark):
    """A row later than the watermark is not counted, one that is not so late is; the state holds open windows only."""
    source, target, offsets = (scratch_path(spark, f"windows-{n}") for n in ("source", "target", "offsets"))
    day = datetime(2024, 1, 1)
    states = []
    for part in ([0, 0, 1], [30], [29], [0], [None, 31]):
        moments = [(None if d is None else day + timedelta(days=d),) for d in part]
        spark.createDataFrame(moments, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
        counts = state.window_counts(state.read_stream(spark, source, "ts timestamp_ntz"), "ts", "1 day", "3 days")
        query = state.upsert_changes(counts, target, "window_start", offsets)
        query.awaitTermination()
        states.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = rows(inc.read_target(spark, target).select(F.datediff("window_start", F.lit(day.date())), "n"))
    assert sorted(got) == [(0, 2), (1, 1), (29, 1), (30, 1), (31, 1)]
    assert states[-1] <= 3
