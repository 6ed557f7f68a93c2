"""The activity mart kept up to date: stored states that increments are added to.

A load aggregates new rows alone and appends their states as one folder, together with the new
high-water mark in one manifest: a load that dies leaves neither, so no row counts twice. Every state is a
sum, a minimum, a maximum or a newest row, so states of any loads add up to those of all rows at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import days_before, utc_now, utc_wall_time
from tidemark.functions.measures import count_where
from tidemark.operators.activity import Activity, value_counts, value_summary, with_busiest, with_derived, with_ranks
from tidemark.operators.aggregates import RECENT_DAY_DAYS, RECENT_ROW_DAYS, in_office_hours, in_weekend, on_weekday, out_of_office_hours
from tidemark.operators.dedupe import latest_rows
from tidemark.operators.incremental import decode_mark, encode_mark, manifest, newer_rows, next_version, publish
from tidemark.session import cut_lineage

# Folders of states that are folded into one beyond this number.
MOST_FOLDERS = 8
_PARTS = ("totals", "days", "moments", "values", "latest")


def activity_states(df: DataFrame, a: Activity) -> dict[str, DataFrame]:
    """Mergeable states of rows: per actor, per actor and day, per instant, per value, and the newest row.

    Recency windows end at a time that moves on, so rows are kept per day, and per instant for the days that a window
    cuts. Each part is combined on the map side: a hot actor is one row per task, day, instant or value.
    """
    rows = df.where(F.col(a.actor).isNotNull())
    wall = utc_wall_time(rows, a.ts)
    timed = rows.select(
        F.col(a.actor), wall.alias("_at"), F.hour(wall).alias("_hour"), F.dayofweek(wall).alias("_dow"), wall.cast("date").alias("_day"),
        *[c.alias(n) for n, c in a.counts.items()], *[F.coalesce(c, F.lit(False)).alias(n) for n, c in a.any_of.items()],
    )
    sums = {
        f"total_{a.noun}": F.count("*"), "_undated": F.count_if(F.col("_at").isNull()),
        **{f"_h{h}": count_where(F.col("_hour") == h) for h in range(24)}, **{f"_d{d}": count_where(F.col("_dow") == d) for d in range(1, 8)},
        f"weekend_{a.noun}": count_where(in_weekend(F.col("_dow"))), f"weekday_{a.noun}": count_where(on_weekday(F.col("_dow"))),
        f"business_hours_{a.noun}": count_where(in_office_hours(F.col("_hour"))), f"off_hours_{a.noun}": count_where(out_of_office_hours(F.col("_hour"))),
        **{n: count_where(F.col(n)) for n in a.counts},
    }
    ends = {**{n: F.max(n) for n in a.any_of}, "first_at": F.min("_at"), "last_at": F.max("_at")}
    parts = {
        "totals": timed.groupBy(a.actor).agg(*[c.alias(n) for n, c in {**sums, **ends}.items()]),
        "days": timed.groupBy(a.actor, "_day").agg(F.count("*").alias("_n")),
        "moments": timed.where("_day IS NOT NULL").groupBy(a.actor, "_day", "_at").agg(F.count("*").alias("_n")),
    }
    if a.distincts or a.modes:
        parts["values"] = value_counts(rows, a)
    if a.latest:
        newest = rows.select(F.col(a.actor), wall.alias("_at"), *[t.alias(f"_tie{i}") for i, t in enumerate(a.latest_ties)], *[c.alias(n) for n, c in a.latest.items()])
        parts["latest"] = latest_rows(newest, [a.actor], _newest_order(a))
    return parts


def _newest_order(a: Activity) -> list[Column]:
    return [F.desc("_at"), *[F.desc(f"_tie{i}") for i in range(len(a.latest_ties))]]


def added_up(states: Mapping[str, DataFrame], a: Activity) -> dict[str, DataFrame]:
    """States of several loads as one: equal keys added up, the newest row of each actor."""
    out = {}
    for name, part in states.items():
        if name == "latest":
            out[name] = latest_rows(part, [a.actor], _newest_order(a))
        elif name == "totals":
            how = {**{n: F.max(n) for n in a.any_of}, "first_at": F.min("first_at"), "last_at": F.max("last_at")}
            out[name] = part.groupBy(a.actor).agg(*[how.get(c, F.sum(c)).alias(c) for c in part.columns if c != a.actor])
        else:
            out[name] = part.groupBy(*[c for c in part.columns if c != "_n"]).agg(F.sum("_n").alias("_n"))
    return out


def mart_of_states(states: Mapping[str, DataFrame], like: DataFrame, a: Activity, as_of: Column) -> DataFrame:
    """All measures of the mart, without ranks, from states; ``like`` has the source's columns, its rows are not read.

    A window takes whole days by their sums; the days that its start cuts are read by instant.
    """
    edges = {n: days_before(as_of, n) for n in RECENT_ROW_DAYS}
    cut = F.col("_day").isin(*[e.cast("date") for e in edges.values()])
    partial = states["moments"].where(cut).groupBy(a.actor, "_day").agg(*[F.sum(F.when(F.col("_at") >= e, F.col("_n"))).alias(f"_part{n}") for n, e in edges.items()])
    days = states["days"].join(partial, [a.actor, "_day"], "left")
    recent = {
        n: F.when(F.col("_day") > e.cast("date"), F.col("_n")).when(F.col("_day") == e.cast("date"), F.coalesce(f"_part{n}", F.lit(0))).otherwise(F.lit(0))
        for n, e in edges.items()
    }
    daily = days.groupBy(a.actor).agg(
        F.count("_day").alias("active_days"), F.avg("_n").alias(f"avg_{a.noun}_per_active_day"), F.max("_n").alias(f"max_{a.noun}_in_day"),
        *[F.sum(c).alias(f"{a.noun}_last_{n}_days") for n, c in recent.items()],
        *[F.count_if(recent[n] > 0).alias(f"active_days_last_{n}") for n in RECENT_DAY_DAYS],
    )
    mart = with_busiest(states["totals"]).join(daily, a.actor)
    if "values" in states:
        mart = mart.join(value_summary(states["values"], like, a), a.actor, "left").fillna(0, subset=list(a.distincts))
    if "latest" in states:
        mart = mart.join(states["latest"].select(a.actor, *a.latest), a.actor, "left")
    return with_derived(mart, a, as_of)


def _stored(spark: SparkSession, path: str, content: dict, name: str) -> DataFrame:
    schema = content["schemas"][name]
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}/{name}" for folder in content["folders"]))


def load_activity(path: str, source: DataFrame, a: Activity, mark_column: str) -> None:
    """Adds the rows above the stored mark to the states at ``path``; the mark filters in the scan.

    Rows without a mark are left out. Late rows count if ``mark_column`` is the time of their arrival. The mark and the states
    are published at once; of two writers of one version, one is refused.
    """
    spark, before = source.sparkSession, manifest(source.sparkSession, path)
    version = next_version(spark, path, before)
    fresh = newer_rows(source, mark_column, decode_mark(before["mark"]) if before else None).where(F.col(mark_column).isNotNull())
    mark = fresh.agg(F.max(mark_column)).first()[0]
    if mark is None and before is not None:
        return
    parts = activity_states(fresh if mark is None else fresh.where(F.col(mark_column) <= F.lit(mark).cast(source.schema[mark_column].dataType)), a)
    folder = f"state-{uuid.uuid4().hex}"
    for name, part in parts.items():
        part.repartitionByRange("_day").write.parquet(f"{path}/{folder}/{name}") if name == "moments" else part.write.parquet(f"{path}/{folder}/{name}")
    schemas = {name: ", ".join(f"`{c}` {kind}" for c, kind in part.dtypes) for name, part in parts.items()}
    content = {"version": version, "mark": encode_mark(mark, source.schema[mark_column].dataType), "folders": [*(before["folders"] if before else []), folder], "schemas": schemas}
    publish(spark, path, content)
    if len(content["folders"]) > MOST_FOLDERS:
        fold_activity(spark, path, a)


def fold_activity(spark: SparkSession, path: str, a: Activity) -> None:
    """All folders of states as one; what they add up to stays the same. Old folders stay for readers."""
    content = manifest(spark, path)
    folder = f"state-{uuid.uuid4().hex}"
    for name, part in added_up({n: _stored(spark, path, content, n) for n in content["schemas"]}, a).items():
        part.repartitionByRange("_day").write.parquet(f"{path}/{folder}/{name}") if name == "moments" else part.write.parquet(f"{path}/{folder}/{name}")
    publish(spark, path, {**content, "version": next_version(spark, path, content), "folders": [folder]})


def stored_activity_mart(spark: SparkSession, path: str, like: DataFrame, a: Activity, as_of: Column | None = None) -> DataFrame:
    """The mart with its ranks, out of the states alone."""
    content = manifest(spark, path)
    if content is None:
        raise ValueError(f"no states at {path}")
    states = added_up({n: _stored(spark, path, content, n) for n in content["schemas"]}, a)
    return with_ranks(cut_lineage(mart_of_states(states, like.limit(0), a, utc_now() if as_of is None else as_of)), a)
