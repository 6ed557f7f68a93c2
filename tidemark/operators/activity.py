"""Contributor activity mart: one wide row per actor."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import days_before, utc_now, utc_wall_time, whole_days
from tidemark.functions.measures import count_where, first_label, percent, ratio
from tidemark.functions.keys import null_safe_greatest
from tidemark.operators.aggregates import (
    RECENT_DAY_DAYS,
    RECENT_ROW_DAYS,
    in_office_hours,
    in_weekend,
    on_weekday,
    out_of_office_hours,
)
from tidemark.operators.dedupe import latest_rows
from tidemark.operators.profile import SLOTS, slot_value, value_slot
from tidemark.operators.ranking import ROWS_PER_RANGE, global_rank
from tidemark.session import cut_lineage

# Activity tiers by the widest window that still has a row.
ACTIVITY_TIERS = [
    (30, "Very Active"),
    (90, "Active"),
    (180, "Moderately Active"),
    (365, "Less Active"),
]
NO_ACTIVITY = "Inactive"


@dataclass(frozen=True)
class Activity:
    """What to measure; every mapping is from output column to expression."""

    actor: str
    ts: str
    noun: str = "events"
    counts: Mapping[str, Column] = field(default_factory=dict)  # rows where true
    any_of: Mapping[str, Column] = field(default_factory=dict)  # true on any row
    distincts: Mapping[str, Column] = field(default_factory=dict)  # distinct values
    modes: Mapping[str, Column] = field(default_factory=dict)  # most frequent value
    latest: Mapping[str, Column] = field(default_factory=dict)  # from the newest row
    latest_ties: Sequence[Column] = ()  # order among rows of the same time
    percents: Mapping[str, str] = field(default_factory=dict)  # output -> count column


def _as(named: Mapping[str, str]) -> list[Column]:
    """Columns of plain SQL expressions; one call each, where there are many."""
    return [F.expr(f"{text} AS {name}") for name, text in named.items()]


def _row_measures(df: DataFrame, a: Activity, as_of: Column) -> DataFrame:
    """Everything that is a sum over rows: one scan, one exchange.

    Each task combines an actor's rows into one before the exchange, so a hot actor
    is one row per task.  Hour and weekday modes need no grouping of their own:
    their domains are 24 and 7 values, which are sums side by side.
    """
    wall = utc_wall_time(df, a.ts)
    conditions = _row_conditions(a, wall, as_of)
    rows = df.select(
        F.col(a.actor),
        wall.alias("_at"),
        F.hour(wall).alias("_hour"),
        F.dayofweek(wall).alias("_dow"),
        *[c.alias(name) for name, c in conditions.items()],
        *[F.coalesce(c, F.lit(False)).alias(name) for name, c in a.any_of.items()],
    )
    hour, weekday = F.col("_hour"), F.col("_dow")
    hours = {f"_h{h}": f"count_if(_hour = {h})" for h in range(24)}
    days = {f"_d{d}": f"count_if(_dow = {d})" for d in range(1, 8)}
    per_actor = rows.groupBy(a.actor).agg(
        *_as({f"total_{a.noun}": "count(*)", "_undated": "count_if(_at IS NULL)", **hours, **days}),
        count_where(in_weekend(weekday)).alias(f"weekend_{a.noun}"),
        count_where(on_weekday(weekday)).alias(f"weekday_{a.noun}"),
        count_where(in_office_hours(hour)).alias(f"business_hours_{a.noun}"),
        count_where(out_of_office_hours(hour)).alias(f"off_hours_{a.noun}"),
        *_as({f"`{name}`": f"count_if(`{name}`)" for name in conditions}),
        *_as({f"`{name}`": f"max(`{name}`)" for name in a.any_of}),
        *_as({"first_at": "min(_at)", "last_at": "max(_at)"}),
    )

    return with_busiest(per_actor)


def with_busiest(per_actor: DataFrame) -> DataFrame:
    """Most active hour and weekday from the sums of all of them, which are dropped."""

    def busiest(slots: Iterable[str], first: int) -> Column:
        # Rows without a time are a slot of their own, in front of all others.
        counts = F.array("_undated", *slots)
        place = F.array_position(counts, F.array_max(counts))
        return F.when(place > 1, (place - 2 + first).cast("bigint"))

    hours, days = [f"_h{h}" for h in range(24)], [f"_d{d}" for d in range(1, 8)]
    return per_actor.withColumns(
        {"most_active_hour": busiest(hours, 0), "most_active_day_of_week": busiest(days, 1)}
    ).drop("_undated", *hours, *days)


def _row_conditions(a: Activity, wall: Column, as_of: Column) -> dict[str, Column]:
    recent = {f"{a.noun}_last_{n}_days": wall >= days_before(as_of, n) for n in RECENT_ROW_DAYS}
    return {**a.counts, **recent}


def _day_measures(df: DataFrame, a: Activity, as_of: Column) -> DataFrame:
    """Active days and rows per day, from a scan of the actor and the time alone.

    Rows without a time count as one day of their own in the intensity, but not as
    an active day.
    """
    wall = utc_wall_time(df, a.ts)
    daily = df.groupBy(a.actor, wall.cast("date").alias("_day")).agg(
        F.count("*").alias("_n"),
        *[count_where(wall >= days_before(as_of, n)).alias(f"_recent{n}") for n in RECENT_DAY_DAYS],
    )
    return daily.groupBy(a.actor).agg(
        *_as(
            {
                "active_days": "count(_day)",
                f"avg_{a.noun}_per_active_day": "avg(_n)",
                f"max_{a.noun}_in_day": "max(_n)",
                **{f"active_days_last_{n}": f"count_if(_recent{n} > 0)" for n in RECENT_DAY_DAYS},
            }
        )
    )


def value_counts(df: DataFrame, a: Activity) -> DataFrame:
    """(_actor, measure, slots, _n): rows per actor, measure and value, from one scan in long form.

    Values are held in the slot of their type: 0.0 and -0.0 are one value.
    """
    wanted = {**a.distincts, **a.modes}
    place = {name: i for i, name in enumerate(wanted)}
    rows = df.select(F.col(a.actor).alias("_actor"), *[c.alias(f"_v{place[name]}") for name, c in wanted.items()])
    fields = {name: rows.schema[f"_v{i}"] for name, i in place.items()}
    slot = {name: value_slot(f)[0] for name, f in fields.items()}
    used = {s: kind for s, kind in SLOTS.items() if s in slot.values()}

    def entry(name: str) -> Column:
        _, value = value_slot(fields[name])
        values = [(value if s == slot[name] else F.lit(None).cast(kind)).alias(s) for s, kind in used.items()]
        return F.struct(F.lit(place[name]).alias("measure"), *values)

    pairs = rows.select("_actor", F.inline(F.array(*map(entry, wanted)))).where(" OR ".join(f"{s} IS NOT NULL" for s in used))
    return pairs.groupBy("_actor", "measure", *used).agg(F.count("*").alias("_n"))


def _value_measures(df: DataFrame, a: Activity) -> DataFrame:
    """Distinct counts and modes: one row per (actor, measure, value) after the first aggregate spreads a hot actor by its values."""
    return value_summary(value_counts(df, a), df, a)


def value_summary(counted: DataFrame, like: DataFrame, a: Activity) -> DataFrame:
    """Distinct counts and modes per actor from counted values; ``like`` has the columns that the measures are made of.

    Ties of numbers go to the smaller number, and a mode keeps its type.
    """
    wanted = {**a.distincts, **a.modes}
    place = {name: i for i, name in enumerate(wanted)}
    fields = {name: like.select(c.alias("v")).schema["v"] for name, c in wanted.items()}
    slot = {name: value_slot(f)[0] for name, f in fields.items()}
    measures = [F.count_if(F.col("measure") == place[name]).alias(name) for name in a.distincts]
    for name in a.modes:
        candidate = F.struct((-F.col("_n")).alias("less"), F.col(slot[name]).alias("value"))
        best = F.min(F.when(F.col("measure") == place[name], candidate))
        measures.append(slot_value(fields[name], best["value"]).alias(name))
    return counted.groupBy("_actor").agg(*measures).withColumnRenamed("_actor", a.actor)


def _latest_profile(df: DataFrame, a: Activity) -> DataFrame:
    rows = df.select(
        F.col(a.actor),
        utc_wall_time(df, a.ts).alias("_at"),
        *[tie.alias(f"_tie{i}") for i, tie in enumerate(a.latest_ties)],
        *[c.alias(name) for name, c in a.latest.items()],
    )
    order = [F.desc("_at"), *[F.desc(f"_tie{i}") for i in range(len(a.latest_ties))]]
    return latest_rows(rows, [a.actor], order).select(a.actor, *a.latest)


def activity_metrics(df: DataFrame, a: Activity, as_of: Column | None = None) -> DataFrame:
    """All measures but the ranks; lazy.  Rows without an actor are left out.

    ``as_of`` is a UTC wall time the recency windows end at; now, by default.
    """
    as_of = utc_now() if as_of is None else as_of
    df = df.where(F.col(a.actor).isNotNull())
    mart = _row_measures(df, a, as_of).join(_day_measures(df, a, as_of), a.actor)
    if a.distincts or a.modes:
        mart = mart.join(_value_measures(df, a), a.actor, "left").fillna(0, subset=list(a.distincts))
    if a.latest:
        mart = mart.join(_latest_profile(df, a), a.actor, "left")
    return with_derived(mart, a, as_of)


def with_derived(mart: DataFrame, a: Activity, as_of: Column) -> DataFrame:
    """Spans, tiers, ratios and percentages from the measures beside them."""
    total = F.col(f"total_{a.noun}")
    tiers = [(F.col(f"{a.noun}_last_{n}_days") > 0, name) for n, name in ACTIVITY_TIERS]
    span = whole_days(F.col("first_at"), F.col("last_at"))
    return mart.withColumn("days_active_span", span).withColumns(
        {
            f"days_since_last_{a.noun.removesuffix('s')}": whole_days(F.col("last_at"), as_of),
            "activity_status": first_label(tiers, NO_ACTIVITY),
            f"{a.noun}_per_active_day": ratio(total, F.col("active_days")),
            f"avg_{a.noun}_per_day_in_span": ratio(
                total, null_safe_greatest(F.col("days_active_span"), F.lit(1).cast("bigint"))
            ),
            **{name: percent(F.col(count), total) for name, count in a.percents.items()},
        }
    )


def activity_mart(
    df: DataFrame, a: Activity, as_of: Column | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """The metrics plus the two global ranks; ties are ranked by actor.

    The metrics are materialised once, since the ranks need the number of actors
    to size their sort.
    """
    return with_ranks(cut_lineage(activity_metrics(df, a, as_of)), a, rows_per_range)


def with_ranks(metrics: DataFrame, a: Activity, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Stored metrics with both global ranks."""
    actors = metrics.count()
    recent = f"{a.noun}_last_90_days"
    ranked = global_rank(
        metrics, [F.desc(recent), F.asc(a.actor)], "rank_by_recent_activity", actors, rows_per_range
    )
    return global_rank(
        ranked, [F.desc(f"total_{a.noun}"), F.asc(a.actor)], f"rank_by_total_{a.noun}", actors, rows_per_range
    )
