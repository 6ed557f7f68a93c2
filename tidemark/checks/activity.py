"""Activity measures over ``events``: user = actor, event type = category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import SQL, Tables, query
from tidemark.functions.measures import percent, ratio
from tidemark.operators import aggregates as agg
from tidemark.operators.activity import Activity, activity_mart
from tidemark.operators.activity_state import load_activity, stored_activity_mart
from tidemark.session import scratch_path

TYPES = ["click", "error", "purchase", "signup", "view"]


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").try_cast("bigint")


def newest(df: DataFrame, column: str) -> Column:
    """The table's last time as a literal: one scalar, so that reports are repeatable."""
    return F.lit(df.agg(F.max(column)).first()[0]).cast("timestamp_ntz")


def event_activity() -> Activity:
    return Activity(
        actor="user_id",
        ts="ts",
        noun="events",
        counts={
            **{f"{t}_events": F.col("event_type") == t for t in TYPES},
            "large_events": F.col("value") > 100,
            "keyed_events": k_of().isNotNull(),
        },
        any_of={"ever_huge": F.col("value") > 400},
        distincts={"distinct_types": F.col("event_type"), "distinct_keys": k_of()},
        modes={"usual_type": F.col("event_type")},
        latest={"last_type": F.col("event_type"), "last_value": F.col("value")},
        latest_ties=[F.col("event_id")],
        percents={
            "click_events_pct": "click_events",
            "error_events_pct": "error_events",
            "large_events_pct": "large_events",
        },
    )


_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
_AS_OF = "(SELECT max(ts) FROM events)"


def _recent(days: int) -> str:
    return f"ts >= {_AS_OF} - INTERVAL {days} DAY"


@query(
    "activity_mart",
    f"""
WITH e AS (
  SELECT *, CAST(ts AS DATE) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(dayofweek(ts) + 1 AS BIGINT) AS dow,
         {_K} AS k
  FROM events WHERE user_id IS NOT NULL),
latest AS (
  SELECT user_id, event_type AS last_type, value AS last_value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1),
usual AS (
  SELECT user_id, event_type AS usual_type FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn
    FROM (SELECT user_id, event_type, count(*) AS n FROM e WHERE event_type IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
hours AS (
  SELECT user_id, h AS most_active_hour FROM (
    SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS rn
    FROM (SELECT user_id, h, count(*) AS n FROM e GROUP BY ALL)) WHERE rn = 1),
dows AS (
  SELECT user_id, dow AS most_active_day_of_week FROM (
    SELECT user_id, dow, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, dow) AS rn
    FROM (SELECT user_id, dow, count(*) AS n FROM e GROUP BY ALL)) WHERE rn = 1),
days AS (
  SELECT user_id, avg(n) AS avg_events_per_active_day, max(n) AS max_events_in_day
  FROM (SELECT user_id, d, count(*) AS n FROM e GROUP BY ALL) GROUP BY user_id),
base AS (
  SELECT user_id, count(*) AS total_events, count(DISTINCT d) AS active_days,
    {", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}_events" for t in TYPES)},
    count(*) FILTER (value > 100) AS large_events,
    count(*) FILTER (k IS NOT NULL) AS keyed_events,
    max(coalesce(value > 400, FALSE)) AS ever_huge,
    count(DISTINCT event_type) AS distinct_types, count(DISTINCT k) AS distinct_keys,
    min(ts) AS first_at, max(ts) AS last_at,
    CAST(trunc((floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000)) / 86400) AS BIGINT)
      AS days_active_span,
    CAST(trunc((floor(epoch_us({_AS_OF}) / 1000000) - floor(epoch_us(max(ts)) / 1000000)) / 86400) AS BIGINT)
      AS days_since_last_event,
    {", ".join(f"count(*) FILTER ({_recent(n)}) AS events_last_{n}_days" for n in agg.RECENT_ROW_DAYS)},
    {", ".join(f"count(DISTINCT CASE WHEN {_recent(n)} THEN d END) AS active_days_last_{n}" for n in agg.RECENT_DAY_DAYS)},
    count(*) FILTER (dow IN (1, 7)) AS weekend_events, count(*) FILTER (dow BETWEEN 2 AND 6) AS weekday_events,
    count(*) FILTER (h BETWEEN 9 AND 17) AS business_hours_events,
    count(*) FILTER (h < 9 OR h > 17) AS off_hours_events
  FROM e GROUP BY user_id)
SELECT base.*, most_active_hour, most_active_day_of_week, avg_events_per_active_day, max_events_in_day,
  usual_type, last_type, last_value,
  CASE WHEN events_last_30_days > 0 THEN 'Very Active' WHEN events_last_90_days > 0 THEN 'Active'
       WHEN events_last_180_days > 0 THEN 'Moderately Active' WHEN events_last_365_days > 0 THEN 'Less Active'
       ELSE 'Inactive' END AS activity_status,
  round(100.0 * (CAST(click_events AS DOUBLE) / total_events), 2) AS click_events_pct,
  round(100.0 * (CAST(error_events AS DOUBLE) / total_events), 2) AS error_events_pct,
  round(100.0 * (CAST(large_events AS DOUBLE) / total_events), 2) AS large_events_pct,
  round(CAST(total_events AS DOUBLE) / nullif(active_days, 0), 2) AS events_per_active_day,
  round(CAST(total_events AS DOUBLE) / greatest(days_active_span, 1), 2) AS avg_events_per_day_in_span,
  row_number() OVER (ORDER BY total_events DESC, user_id) AS rank_by_total_events,
  row_number() OVER (ORDER BY events_last_90_days DESC, user_id) AS rank_by_recent_activity
FROM base LEFT JOIN latest USING (user_id) LEFT JOIN usual USING (user_id)
LEFT JOIN hours USING (user_id) LEFT JOIN dows USING (user_id) LEFT JOIN days USING (user_id)
""",
)
def _activity_mart(t: Tables) -> DataFrame:
    events = t.events
    return activity_mart(events, event_activity(), newest(events, "ts")).orderBy(F.desc("total_events"), "user_id")


@query("activity_mart_incremental", SQL["activity_mart"])
def _activity_mart_incremental(t: Tables) -> DataFrame:
    """Two loads, by arrival: what arrives late falls on days and actors that the first load knew; the mart comes from states alone."""
    path, a, events = scratch_path(t.spark, "activity"), event_activity(), t.events
    late = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 9 DAYS")).otherwise(F.col("ts"))
    arriving = events.withColumn("arrived", late)
    middle = F.lit(arriving.agg(F.expr("timestampadd(SECOND, CAST(timestampdiff(SECOND, min(arrived), max(arrived)) / 2 AS INT), min(arrived))")).first()[0])
    load_activity(path, arriving.where(F.col("arrived") <= middle.cast("timestamp_ntz")), a, "arrived")
    load_activity(path, arriving, a, "arrived")
    return stored_activity_mart(t.spark, path, arriving, a, newest(events, "ts"))


@query(
    "conditional_counts",
    f"""SELECT user_id, {", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}_events" for t in TYPES)},
    count(*) FILTER (coalesce(value > 100, FALSE)) AS large_events,
    count(*) FILTER (NOT coalesce(value > 100, FALSE)) AS small_events
    FROM events GROUP BY user_id""",
)
def _conditional_counts(t: Tables) -> DataFrame:
    large = F.coalesce(F.col("value") > 100, F.lit(False))
    conditions = {f"{name}_events": F.col("event_type") == name for name in TYPES}
    return agg.conditional_counts(t.events, ["user_id"], {**conditions, "large_events": large, "small_events": ~large})


@query(
    "multi_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders,
    count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned_orders
    FROM lineitem GROUP BY l_suppkey""",
)
def _multi_distinct(t: Tables) -> DataFrame:
    return agg.distinct_counts(
        t.lineitem,
        ["l_suppkey"],
        {
            "parts": F.col("l_partkey"),
            "orders": F.col("l_orderkey"),
            "returned_orders": (F.col("l_orderkey"), F.col("l_returnflag") == "R"),
        },
    )


@query(
    "typed_distincts",
    """SELECT l_returnflag, l_linestatus, count(DISTINCT l_extendedprice) AS prices, count(DISTINCT l_shipdate) AS moments, count(DISTINCT CAST(l_shipdate AS DATE)) AS days,
    count(DISTINCT CASE WHEN l_quantity < 10 THEN CAST(l_shipdate AS DATE) END) AS small_days, count(DISTINCT 'supplier ' || l_suppkey || ' of the part ' || l_partkey) AS labels,
    count(DISTINCT CASE WHEN l_quantity < 0 THEN l_orderkey END) AS none, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _typed_distincts(t: Tables) -> DataFrame:
    """Values of every kind; long texts count by digest, and few keys hold all rows."""
    day = F.col("l_shipdate").cast("date")
    label = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" of the part "), F.col("l_partkey").cast("string"))
    return agg.distinct_counts(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        {
            "none": (F.col("l_orderkey"), F.col("l_quantity") < 0), "orders": F.col("l_orderkey"), "prices": F.col("l_extendedprice"), "moments": F.col("l_shipdate"),
            "days": day, "small_days": (day, F.col("l_quantity") < 10), "labels": label,
        },
    )


@query(
    "recency_counts",
    f"""SELECT user_id,
    {", ".join(f"count(*) FILTER ({_recent(n)}) AS events_last_{n}_days" for n in agg.RECENT_ROW_DAYS)},
    {", ".join(f"count(DISTINCT CASE WHEN {_recent(n)} THEN CAST(ts AS DATE) END) AS active_days_last_{n}" for n in agg.RECENT_DAY_DAYS)},
    max(ts) AS most_recent_at FROM events GROUP BY user_id""",
)
def _recency_counts(t: Tables) -> DataFrame:
    events = t.events
    return agg.recency_counts(events, "user_id", "ts", newest(events, "ts"), "events")


@query(
    "active_days",
    """SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
    count(DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE)) AS active_weeks FROM orders GROUP BY o_custkey""",
)
def _active_days(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return agg.distinct_counts(t.orders, ["o_custkey"], {"active_days": day, "active_weeks": F.trunc(day, "week")})


@query(
    "day_span",
    """SELECT user_id, min(ts) AS first_at, max(ts) AS last_at,
    CAST(trunc((floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000)) / 86400) AS BIGINT)
    AS days_active_span FROM events GROUP BY user_id""",
)
def _day_span(t: Tables) -> DataFrame:
    return agg.time_span(t.events, "user_id", "ts")


@query(
    "group_mode",
    """SELECT user_id, event_type AS usual_type, n AS usual_type_count FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (
      SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
)
def _group_mode(t: Tables) -> DataFrame:
    return agg.group_mode(t.events, "user_id", "event_type", "usual_type")


@query(
    "per_day_intensity",
    """SELECT user_id, count(d) AS active_days, avg(n) AS avg_events_per_active_day, max(n) AS max_events_in_day
    FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def _per_day_intensity(t: Tables) -> DataFrame:
    return agg.day_intensity(t.events, "user_id", "ts", "events")


@query(
    "time_of_week",
    """SELECT user_id, count(*) FILTER (dayofweek(ts) + 1 IN (1, 7)) AS weekend_events,
    count(*) FILTER (dayofweek(ts) + 1 BETWEEN 2 AND 6) AS weekday_events,
    count(*) FILTER (hour(ts) BETWEEN 9 AND 17) AS business_hours_events,
    count(*) FILTER (hour(ts) < 9 OR hour(ts) > 17) AS off_hours_events FROM events GROUP BY user_id""",
)
def _time_of_week(t: Tables) -> DataFrame:
    return agg.time_of_week(t.events, "user_id", "ts", "events")


@query(
    "ratio_metrics",
    """SELECT l_suppkey, round(100.0 * (CAST(returned AS DOUBLE) / lines), 2) AS returned_pct,
    round(CAST(lines AS DOUBLE) / nullif(open_lines, 0), 2) AS lines_per_open_line,
    round(CAST(lines AS DOUBLE) / greatest(open_lines, 1), 2) AS lines_per_open_line_at_least_one
    FROM (SELECT l_suppkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned,
    count(*) FILTER (l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY l_suppkey)""",
)
def _ratio_metrics(t: Tables) -> DataFrame:
    counted = agg.conditional_counts(
        t.lineitem,
        ["l_suppkey"],
        {
            "lines": F.lit(True),
            "returned": F.col("l_returnflag") == "R",
            "open_lines": F.col("l_linestatus") == "O",
        },
    )
    lines = F.col("lines")
    return counted.select(
        "l_suppkey",
        percent(F.col("returned"), lines).alias("returned_pct"),
        ratio(lines, F.col("open_lines")).alias("lines_per_open_line"),
        ratio(lines, F.greatest("open_lines", F.lit(1).cast("bigint"))).alias("lines_per_open_line_at_least_one"),
    )


@query(
    "bool_or",
    """SELECT d.source, max(coalesce(l.toxic = 1, FALSE)) AS any_toxic, max(coalesce(l.quality = 1, FALSE)) AS any_good
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""",
)
def _bool_or(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels, "doc_id", "left")
    return agg.any_true(labelled, ["source"], {"any_toxic": F.col("toxic") == 1, "any_good": F.col("quality") == 1})


@query(
    "latest_attributes",
    """SELECT user_id, event_type, value, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _latest_attributes(t: Tables) -> DataFrame:
    return agg.latest_attributes(
        t.events, "user_id", [F.desc("ts"), F.desc("event_id")], ["event_type", "value", "ts"]
    )


@query(
    "count_by_label",
    """SELECT coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality, count(*) AS n_documents
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.quality""",
)
def _count_by_label(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels, "doc_id", "left").select(F.col("quality").cast("string"))
    return agg.labelled_count(labelled, "quality", "unknown", "n_documents")


@query(
    "group_counts",
    "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
)
def _group_counts(t: Tables) -> DataFrame:
    return agg.group_count(t.documents, ["lang", "source"])
