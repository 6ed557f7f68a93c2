"""Incremental, late-data and streaming loads; their end state is compared.

The target is a scratch table below the shared folder.  ``events`` plays the
source: event time is ``ts``; ingest time is a day later for every error event,
which therefore arrives late.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import SQL, Tables, query
from tidemark.checks.repository import report_sql
from tidemark.operators.aggregates import labelled_count
from tidemark.operators.incremental import (
    high_water,
    load_increment,
    merge_rows,
    newer_rows,
    read_target,
    upsert,
)
from tidemark.operators.dedupe import latest_rows
from tidemark.operators.quality import run_checks
from tidemark.operators.snapshot import snapshot_changes, write_snapshot
from tidemark.plans import show_catalog
from tidemark.session import scratch_path
from tidemark.sources.catalog import describe
from tidemark.sources.readers import query as sql_query
from tidemark.sources.readers import read_json_lines, read_texts, sample_n
from tidemark.sources.sinks import publish_view, write_landing, write_table
from tidemark.streaming.state import newest_changes, read_stream, upsert_changes, window_counts
from tidemark.streaming.upsert import stream_upsert

CUT = "2024-01-15 00:00:00"
# Lines of a corpus file: what a task holds as one text.
CORPUS_LINES = 100_000
_LATE = "CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 DAY ELSE ts END"


def cut() -> Column:
    return F.lit(CUT).cast("timestamp_ntz")


def sourced(t: Tables) -> DataFrame:
    late = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return t.events.select("event_id", "user_id", "event_type", "ts", late.alias("ingested_at"), "value")


@query(
    "incremental_upsert",
    f"""SELECT user_id, event_id, ts, ingested_at, value FROM (SELECT *, {_LATE} AS ingested_at,
    row_number() OVER (PARTITION BY user_id ORDER BY {_LATE} DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _incremental_upsert(t: Tables) -> DataFrame:
    """Two runs on ingest time and a repeated one: the newest row per user."""
    path, source = scratch_path(t.spark, "upsert"), sourced(t)
    order = [F.desc("ingested_at"), F.desc("event_id")]
    for rows in (source.where(F.col("ingested_at") <= cut()), source, source):
        load_increment(path, rows, "user_id", "ingested_at", order)
    return read_target(t.spark, path).select("user_id", "event_id", "ts", "ingested_at", "value")


@query(
    "ranged_upsert",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 100 = 1 THEN 'Z' WHEN q = 2 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice FROM (SELECT *, CASE WHEN o_orderkey > (SELECT max(o_orderkey) * 0.9 FROM orders) THEN 1
        WHEN o_orderkey BETWEEN (SELECT max(o_orderkey) * 0.4 FROM orders) AND (SELECT max(o_orderkey) * 0.41 FROM orders) THEN 2 END AS q FROM orders)""",
)
def _ranged_upsert(t: Tables) -> DataFrame:
    """A base in many key ranges: new keys behind it, changed keys near one another, and some all over it."""
    path, orders = scratch_path(t.spark, "ranges"), t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    count, last = orders.agg(F.count("*"), F.max("o_orderkey")).first()
    changed = orders.where(F.col("o_orderkey").between(0.4 * last, 0.41 * last)).withColumn("o_orderstatus", F.lit("X"))
    scattered = orders.where("o_custkey % 100 = 1").withColumn("o_orderstatus", F.lit("Z"))
    batches = (orders.where(F.col("o_orderkey") <= 0.9 * last), orders.where(F.col("o_orderkey") > 0.9 * last), changed, scattered)
    for batch in batches:
        upsert(path, batch, "o_orderkey", rows_per_range=max(1, count // 40))
    return read_target(t.spark, path)


@query(
    "incremental_event_time",
    f"""WITH s AS (SELECT *, {_LATE} AS ingested_at FROM events),
    first_run AS (SELECT * FROM s WHERE ingested_at <= TIMESTAMP '{CUT}')
    SELECT event_id, user_id, ts, value FROM first_run UNION ALL
    SELECT event_id, user_id, ts, value FROM s WHERE ingested_at > TIMESTAMP '{CUT}' AND ts > (SELECT max(ts) FROM first_run)""",
)
def _incremental_event_time(t: Tables) -> DataFrame:
    """On event time, rows that arrive after a newer one was loaded stay lost."""
    path, source = scratch_path(t.spark, "upsert"), sourced(t)
    for rows in (source.where(F.col("ingested_at") <= cut()), source):
        load_increment(path, rows, "event_id", "ts", [F.desc("ingested_at")])
    return read_target(t.spark, path).select("event_id", "user_id", "ts", "value")


@query(
    "late_data_upsert",
    f"""SELECT event_id, user_id, ts, value FROM events""",
)
def _late_data_upsert(t: Tables) -> DataFrame:
    """With a lookback as long as the delay, event time loses nothing."""
    path, source = scratch_path(t.spark, "upsert"), sourced(t)
    for rows in (source.where(F.col("ingested_at") <= cut()), source):
        load_increment(
            path, rows, "event_id", "ts", [F.desc("ingested_at")], lookback=timedelta(days=1, seconds=1)
        )
    return read_target(t.spark, path).select("event_id", "user_id", "ts", "value")


@query(
    "merge_newer_only",
    """SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""",
)
def _merge_newer_only(t: Tables) -> DataFrame:
    """Oldest order per customer over the newest: the guard keeps the newer row."""
    rows = t.orders.select("o_custkey", "o_orderdate")
    newest = latest_rows(rows, ["o_custkey"], [F.desc("o_orderdate")])
    oldest = latest_rows(rows, ["o_custkey"], [F.asc("o_orderdate")])
    return merge_rows(newest, oldest, "o_custkey", newer_by="o_orderdate")


@query(
    "high_water_scan",
    f"""SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '{CUT}')""",
)
def _high_water_scan(t: Tables) -> DataFrame:
    mark = high_water(t.events.where(F.col("ts") <= cut()), "ts")
    return newer_rows(t.events.select("event_id", "ts"), "ts", mark)


@query(
    "full_refresh",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def _full_refresh(t: Tables) -> DataFrame:
    """A refresh replaces the table, whatever it held."""
    path, rows = scratch_path(t.spark, "refresh"), t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    upsert(path, rows, "o_orderkey")
    upsert(path, rows.where("o_orderstatus = 'F'"), "o_orderkey", full_refresh=True)
    return read_target(t.spark, path).select("o_orderkey", "o_totalprice")


@query(
    "stream_upsert",
    """SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _stream_upsert(t: Tables) -> DataFrame:
    """Events landed as files, streamed in micro-batches: same end state as a batch.

    The files hold rising times, so that a later batch carries the newer rows.
    """
    landing, target = scratch_path(t.spark, "landing"), scratch_path(t.spark, "stream")
    events = t.events
    for part in (events.where(F.col("ts") <= cut()), events.where(F.col("ts") > cut())):
        part.write.mode("append").parquet(landing)
    stream_upsert(
        t.spark, landing, events.schema, target, ["user_id", "event_type"],
        [F.desc("ts"), F.desc("event_id")], scratch_path(t.spark, "offsets"), files_per_batch=4,
        newer_by="ts",
    ).awaitTermination()
    return read_target(t.spark, target).select("user_id", "event_type", "event_id", "ts", "value")


def _landed(t: Tables, *parts: Column) -> str:
    """Events landed part by part, so that files of a later part have later names and times."""
    landing = scratch_path(t.spark, "landing")
    for part in parts:
        t.events.where(part).coalesce(2).write.mode("append").parquet(landing)
    return landing


@query("stream_newest", SQL["stream_upsert"])
def _stream_newest(t: Tables) -> DataFrame:
    """State per key over micro-batches, newest events first: what arrives late changes nothing, and the end is that of a batch."""
    landing, target, events = _landed(t, F.col("ts") > cut(), F.col("ts") <= cut()), scratch_path(t.spark, "newest"), t.events
    keys = ["user_id", "event_type"]
    changes = newest_changes(read_stream(t.spark, landing, events.schema, files_per_batch=2), keys, ["ts", "event_id"])
    upsert_changes(changes, target, keys, scratch_path(t.spark, "offsets")).awaitTermination()
    return read_target(t.spark, target).select("user_id", "event_type", "event_id", "ts", "value")


@query(
    "stream_window_counts",
    "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
)
def _stream_window_counts(t: Tables) -> DataFrame:
    """Events per day and type; errors arrive in a later micro-batch, but before the watermark gives their days up."""
    error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    landing, target = _landed(t, (F.col("ts") <= cut()) & ~error, (F.col("ts") <= cut()) & error, F.col("ts") > cut()), scratch_path(t.spark, "windows")
    counts = window_counts(read_stream(t.spark, landing, t.events.schema, files_per_batch=2), "ts", "1 day", "40 days", ["event_type"])
    upsert_changes(counts, target, ["window_start", "event_type"], scratch_path(t.spark, "offsets")).awaitTermination()
    return read_target(t.spark, target).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "landing_round_trip",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def _landing_round_trip(t: Tables) -> DataFrame:
    """JSON lines out and in again, under a given schema."""
    path = scratch_path(t.spark, "jsonl")
    write_landing(t.conversations, path)
    return read_json_lines(t.spark, path, t.conversations.schema)


@query(
    "table_sink",
    "SELECT n_nationkey, n_name, 'nation''s key' AS key_comment FROM nation",
)
def _table_sink(t: Tables) -> DataFrame:
    """Overwrite a table twice; column comments survive the write."""
    path = scratch_path(t.spark, "table")
    described = describe(t.nation.select("n_nationkey", "n_name"), {"n_nationkey": "nation's key"})
    write_table(t.region, path)
    write_table(described, path)
    df = t.spark.read.parquet(path)
    return df.withColumn("key_comment", F.lit(df.schema["n_nationkey"].metadata["comment"]))


@query(
    "text_corpus",
    """SELECT source || '/' || lang AS path, count(DISTINCT doc_id // 8) AS n_files, count(*) AS n_lines FROM documents GROUP BY source, lang""",
)
def _text_corpus(t: Tables) -> DataFrame:
    """A folder per source and language, the small texts of it as headed lines of a few large files, read back whole and told apart by their headers."""
    folder = scratch_path(t.spark, "texts")
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.concat(F.lit("-- file "), known(F.floor(F.col("doc_id") / 8)), F.lit(" doc "), known(F.col("doc_id")))
    lines = t.documents.select("source", "lang", value.alias("value"))
    # As many files as there are bytes, not texts: one of its own per text would be listed and renamed one by one. A huge folder is split.
    writer = lines.hint("rebalance", "source", "lang").write.partitionBy("source", "lang").option("maxRecordsPerFile", CORPUS_LINES)
    writer.text(folder)
    texts = read_texts(t.spark, folder, "*.txt")
    places = [F.regexp_extract("path", rf"{name}=([^/]*)/", 1).alias(name) for name in ("source", "lang")]
    found = texts.select(*places, F.explode(F.regexp_extract_all("text", F.lit("-- file (-?[0-9]*) doc"), F.lit(1))).alias("file"))
    counted = found.groupBy("source", "lang", "file").agg(F.count("*").alias("n"))
    given = lambda c: F.nullif(F.col(c), F.lit("__HIVE_DEFAULT_PARTITION__"))
    path = F.concat(given("source"), F.lit("/"), given("lang")).alias("path")
    # Texts without an id are lines of no file.
    return counted.groupBy("source", "lang").agg(F.count_if(F.col("file") != "").alias("n_files"), F.sum("n").alias("n_lines")).select(path, "n_files", "n_lines")


@query(
    "parameter_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000.5",
)
def _parameter_query(t: Tables) -> DataFrame:
    publish_view(t.orders, "tidemark_orders")
    return sql_query(
        t.spark,
        "SELECT o_orderkey, o_totalprice FROM tidemark_orders WHERE o_orderstatus = ? AND o_totalprice > ?",
        "O",
        1000.5,
    )


@query(
    "show_characters",
    """SELECT CAST(c_custkey AS INTEGER) AS character_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS status,
    nullif(CASE WHEN c_nationkey > 12 THEN '' ELSE 'type' || c_nationkey END, '') AS character_type,
    TIMESTAMP '2017-11-04 18:48:46' + to_days(c_nationkey) AS created_at FROM customer""",
)
def _show_characters(t: Tables) -> DataFrame:
    return characters(t).select(
        "character_id", "name", "status", "character_type", F.col("created_at").cast("timestamp_ntz").alias("created_at")
    )


def characters(t: Tables) -> DataFrame:
    """Customers as flat text records of characters."""
    nothing = F.lit(None).cast("string")
    nation = F.col("c_nationkey")
    created = F.date_add(F.lit("2017-11-04").cast("date"), nation)
    landed = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("status"),
        F.when(nation > 12, "").otherwise(F.concat(F.lit("type"), nation.cast("string"))).alias("type"),
        F.concat(created.cast("string"), F.lit("T18:48:46.000Z")).alias("created"),
        *[nothing.alias(c) for c in ("species", "gender", "origin_name", "origin_url", "location_name", "location_url", "image", "url")],
    )
    return show_catalog.stage_characters(landed)


@query(
    "character_status",
    """SELECT coalesce(s, 'unknown') AS status, count(*) AS character_count
    FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS s FROM customer) GROUP BY s""",
)
def _character_status(t: Tables) -> DataFrame:
    return show_catalog.character_status(characters(t))


def episodes(t: Tables) -> DataFrame:
    """Parts as flat text records of episodes with ``p_size`` characters each."""
    size = F.col("p_size")
    landed = t.part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("air_date"),
        F.col("p_brand").alias("episode"),
        F.lit("u").alias("url"),
        F.lit("2017-11-10T12:56:33Z").alias("created"),
        F.when(size > 25, F.to_json(F.transform(F.sequence(F.lit(1), size), lambda i: i.cast("string")))).alias("characters"),
    )
    return show_catalog.stage_episodes(landed)


@query(
    "episode_summary",
    """SELECT CAST(p_partkey AS INTEGER) AS episode_id, p_brand AS episode_code, p_name AS name, p_type AS air_date,
    CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS character_count FROM part""",
)
def _episode_summary(t: Tables) -> DataFrame:
    return show_catalog.episode_summary(episodes(t))


@query(
    "episode_character_counts",
    """SELECT CAST(p_partkey AS INTEGER) AS episode_id, p_brand AS episode_code, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS character_count,
    TIMESTAMP '2017-11-10 12:56:33' AS created_at FROM part""",
)
def _episode_character_counts(t: Tables) -> DataFrame:
    counts = show_catalog.episode_character_counts(episodes(t))
    return counts.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "location_summary",
    """SELECT CAST(s_suppkey AS INTEGER) AS location_id, s_name AS name, nullif(CASE WHEN s_acctbal > 0 THEN '' ELSE 'type' END, '') AS location_type,
    'dim' || CAST(s_nationkey AS VARCHAR) AS dimension, s_nationkey AS resident_count FROM supplier""",
)
def _location_summary(t: Tables) -> DataFrame:
    return show_catalog.location_summary(locations(t))


def locations(t: Tables) -> DataFrame:
    """Suppliers as locations with as many residents as their nation's number."""
    nation = F.col("s_nationkey")
    people = F.when(nation > 0, F.sequence(F.lit(1), nation)).otherwise(F.array().cast("array<int>"))
    landed = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, "").otherwise("type").alias("type"),
        F.concat(F.lit("dim"), nation.cast("string")).alias("dimension"),
        F.lit(None).cast("string").alias("url"),
        F.lit("2017-11-10T12:42:04.162Z").alias("created"),
        F.to_json(people).alias("residents"),
    )
    return show_catalog.stage_locations(landed)


@query(
    "label_counts",
    """SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM (
    SELECT CASE WHEN quality = 1 THEN lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""",
)
def _label_counts(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    return labelled_count(df.select(F.when(F.col("quality") == 1, F.col("lang")).alias("lang")), "lang", "unknown", "n")


_CATALOG = ("characters", "episodes", "locations", "episode_character_counts", "episode_summary", "location_summary", "character_status")


def _catalog_sql() -> str:
    as_query = {"characters": "show_characters", "episodes": "episode_summary", "locations": "location_summary"}
    return report_sql({n: SQL[as_query.get(n, n)] for n in _CATALOG}, show_catalog.catalog_checks())


@query("catalog_check_report", _catalog_sql())
def _catalog_check_report(t: Tables) -> DataFrame:
    """All checks of the show catalog."""
    people, parts, places = characters(t), episodes(t), locations(t)
    tables = {
        "characters": people, "episodes": parts, "locations": places,
        "episode_character_counts": show_catalog.episode_character_counts(parts),
        "episode_summary": show_catalog.episode_summary(parts),
        "location_summary": show_catalog.location_summary(places),
        "character_status": show_catalog.character_status(people),
    }
    return run_checks(tables, show_catalog.catalog_checks())


_DRAWN = "md5('7|=' || l_orderkey || '|=' || l_linenumber)"


@query("sample_rows_n", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY {_DRAWN} LIMIT 1000")
def _sample_rows_n(t: Tables) -> DataFrame:
    """Exactly a thousand rows, the same in any partitioning."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition(13)
    return sample_n(rows, 1000, ["l_orderkey", "l_linenumber"], seed=7)


@query(
    "sample_per_stratum",
    f"""SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (
    PARTITION BY l_returnflag, l_linestatus ORDER BY {_DRAWN}) AS rn FROM lineitem) WHERE rn <= 50""",
)
def _sample_per_stratum(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return sample_n(rows, 50, ["l_orderkey", "l_linenumber"], seed=7, by=["l_returnflag", "l_linestatus"])


@query(
    "snapshot_changes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 1 THEN 'added' WHEN o_orderkey % 991 = 2 THEN 'removed' ELSE 'changed' END AS change
    FROM orders WHERE (o_orderkey % 997 = 1) <> (o_orderkey % 991 = 2)
      OR (o_orderkey % 997 <> 1 AND o_orderkey % 991 <> 2 AND o_orderkey % 983 = 3)""",
)
def _snapshot_changes(t: Tables) -> DataFrame:
    """Two states of orders that differ in few rows: one added, one removed and one changed in about a thousand."""
    old, new, orders = scratch_path(t.spark, "snapshot"), scratch_path(t.spark, "snapshot"), t.orders
    write_snapshot(orders.where("o_orderkey % 997 <> 1"), old, ["o_orderkey"], range_bits=6)
    status = F.when(F.col("o_orderkey") % 983 == 3, F.lit(None)).otherwise(F.col("o_orderstatus"))
    write_snapshot(orders.where("o_orderkey % 991 <> 2").withColumn("o_orderstatus", status), new, ["o_orderkey"], range_bits=6)
    return snapshot_changes(t.spark, old, new)
