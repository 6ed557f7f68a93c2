"""Projections, casts, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.activity import k_of
from tidemark.checks.registry import Tables, query
from tidemark.functions import keys, parsing, text
from tidemark.functions.calendar import days_before, whole_days, with_calendar
from tidemark.functions.measures import first_label
from tidemark.operators.dedupe import latest_rows
from tidemark.operators.flatten import flatten_payload
from tidemark.operators.quality import required_rows


@query(
    "json_flatten",
    """SELECT event_id, json_extract_string(j, '$.user.id') AS user_text,
    TRY_CAST(json_extract_string(j, '$.user.id') AS BIGINT) AS user_number,
    json_extract_string(j, '$.kind') AS kind,
    CASE WHEN json_type(j, '$.props') IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(j, '$.props') END AS props_scalar,
    json_extract_string(j, '$.props') AS props_json,
    TRY_CAST(json_extract_string(j, '$.props.k') AS BIGINT) AS k,
    json_extract_string(j, '$.missing') AS missing,
    (json_extract_string(j, '$.flag') = 'true') AS flag
    FROM (SELECT event_id, CAST(json_object('kind', event_type, 'flag', value > 100,
      'user', json_object('id', user_id), 'props', CAST(props AS JSON)) AS JSON) AS j FROM events)""",
)
def _json_flatten(t: Tables) -> DataFrame:
    """Events packed into one JSON payload, then taken apart again."""
    payload = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"),
            (F.col("value") > 100).alias("flag"),
            F.struct(F.col("user_id").alias("id")).alias("user"),
            F.from_json("props", "struct<k bigint>").alias("props"),
        )
    )
    landed = t.events.select("event_id", payload.alias("data"))
    flat = flatten_payload(
        landed,
        {
            "user_text": ("user.id", "text"),
            "kind": ("kind", "text"),
            "flag": ("flag", "bool"),
            "missing": ("missing", "text"),
            "k": ("props.k", "int"),
        },
        keep=["event_id", "data"],
    )
    return flat.select(
        "event_id",
        "user_text",
        parsing.safe_int(F.col("user_text")).alias("user_number"),
        "kind",
        parsing.json_scalar(F.col("data"), "$.props").alias("props_scalar"),
        parsing.json_object_text(F.col("data"), "$.props").alias("props_json"),
        "k",
        "missing",
        "flag",
    )


@query(
    "safe_parse",
    """SELECT doc_id, TRY_CAST(source AS BIGINT) AS bad_number,
    TRY_CAST(substr(source, 4) AS BIGINT) AS source_number,
    CASE WHEN lower(quality_text) IN ('true', 'false') THEN lower(quality_text) = 'true' END AS strict_flag,
    CASE WHEN quality IS NULL THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) END AS parsed_at
    FROM (SELECT *, CASE WHEN toxic = 1 THEN 'yes' WHEN quality = 1 THEN 'TRUE' WHEN quality = 0 THEN 'false' END AS quality_text
      FROM documents LEFT JOIN labels USING (doc_id))""",
)
def _safe_parse(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    word = F.when(F.col("toxic") == 1, "yes").when(F.col("quality") == 1, "TRUE").when(F.col("quality") == 0, "false")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    moment = F.timestamp_add("SECOND", F.col("doc_id").cast("int"), start)
    # Unlabelled documents carry a date without a time of day, which does not parse.
    stamp = F.when(F.col("quality").isNotNull(), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(moment, "yyyy-MM-dd")
    )
    return df.select(
        "doc_id",
        parsing.safe_int(F.col("source")).alias("bad_number"),
        parsing.safe_int(F.substring("source", 4, 10)).alias("source_number"),
        parsing.safe_bool(word).alias("strict_flag"),
        parsing.safe_timestamp(stamp).cast("timestamp_ntz").alias("parsed_at"),
    )


@query(
    "strict_cast",
    """SELECT CAST(CAST(o_orderkey AS VARCHAR) AS INTEGER) AS order_key, CAST(o_orderdate AS TIMESTAMP) AS ordered_at,
    nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '') AS order_status FROM orders""",
)
def _strict_cast(t: Tables) -> DataFrame:
    landed = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("string").alias("created"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("type"),
    )
    return landed.select(
        F.col("id").cast("int").alias("order_key"),
        F.col("created").cast("timestamp_ntz").alias("ordered_at"),
        keys.blank_to_null(F.col("type")).alias("order_status"),
    )


@query(
    "latest_per_key",
    """SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _latest_per_key(t: Tables) -> DataFrame:
    newest = latest_rows(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return newest.select("user_id", "event_type", "event_id", "ts", "value")


@query(
    "latest_per_key_multi_sort",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def _latest_multi_sort(t: Tables) -> DataFrame:
    order = [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")]
    return latest_rows(t.orders, ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "latest_by_coalesced_ts",
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 30 DAY END,
      CASE WHEN l_linestatus = 'F' THEN l_shipdate END, TIMESTAMP '1990-01-01') DESC,
      l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""",
)
def _latest_by_coalesced_ts(t: Tables) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS"))
    finished = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))
    touched = F.coalesce(returned, finished, F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"))
    order = [touched.desc(), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_shipdate")]
    return latest_rows(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(
    "surrogate_key",
    """SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || ':' || coalesce(CAST(quality AS VARCHAR), '')
    || ':pr:' || CAST(doc_id AS VARCHAR) AS document_sk FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _surrogate_key(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    return df.select("doc_id", keys.surrogate_key(["source", "lang", "quality", "doc_id"], ["/", ":", ":pr:"]).alias("document_sk"))


@query(
    "label_concat",
    """SELECT doc_id, source || '/' || lang AS full_name, lang || '/' || CAST(quality AS VARCHAR) AS quality_name
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _label_concat(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    return df.select(
        "doc_id",
        keys.label("source", "lang").alias("full_name"),
        keys.label("lang", F.col("quality").cast("string")).alias("quality_name"),
    )


@query(
    "calendar_dims",
    """SELECT event_id, CAST(ts AS DATE) AS event_date, CAST(date_trunc('week', ts) AS DATE) AS event_week,
    CAST(date_trunc('month', ts) AS DATE) AS event_month, CAST(date_trunc('quarter', ts) AS DATE) AS event_quarter,
    CAST(date_trunc('year', ts) AS DATE) AS event_year, CAST(dayofweek(ts) + 1 AS BIGINT) AS event_day_of_week,
    CAST(hour(ts) AS BIGINT) AS event_hour FROM events""",
)
def _calendar_dims(t: Tables) -> DataFrame:
    df = with_calendar(t.events, "ts", "event")
    return df.select("event_id", *[c for c in df.columns if c.startswith("event_") and c not in ("event_id", "event_type")])


@query(
    "order_calendar",
    """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS order_week, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS order_quarter,
    CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS order_day_of_week, count(*) AS n FROM orders GROUP BY ALL""",
)
def _order_calendar(t: Tables) -> DataFrame:
    df = with_calendar(t.orders, "o_orderdate", "order")
    return df.groupBy("order_week", "order_quarter", "order_day_of_week").agg(F.count("*").alias("n"))


@query(
    "date_arithmetic",
    """SELECT o_orderkey, o_orderdate - INTERVAL 30 DAY AS month_before,
    CAST(trunc((epoch(TIMESTAMP '1998-08-02 13:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days_open FROM orders""",
)
def _date_arithmetic(t: Tables) -> DataFrame:
    moment = F.lit("1998-08-02 13:00:00").cast("timestamp_ntz")
    return t.orders.select(
        "o_orderkey",
        days_before(F.col("o_orderdate"), 30).alias("month_before"),
        whole_days(F.col("o_orderdate"), moment).alias("days_open"),
    )


_MESSAGE = """CASE event_type WHEN 'click' THEN 'feat(' || event_type || '): ' WHEN 'error' THEN 'FIX:' WHEN 'view' THEN 'docs: '
  WHEN 'signup' THEN 'perf:' ELSE 'Chore(' END || 'x' || CAST(event_id AS VARCHAR) || CASE WHEN value > 100 THEN ' (#' || CAST(user_id AS VARCHAR) || ') #7' ELSE ' # 9' END"""


def messages(t: Tables) -> DataFrame:
    """A change message per event."""
    head = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("feat("), F.col("event_type"), F.lit("): ")))
        .when(F.col("event_type") == "error", F.lit("FIX:"))
        .when(F.col("event_type") == "view", F.lit("docs: "))
        .when(F.col("event_type") == "signup", F.lit("perf:"))
        .otherwise(F.lit("Chore("))
    )
    tail = F.when(F.col("value") > 100, F.concat(F.lit(" (#"), F.col("user_id").cast("string"), F.lit(") #7"))).otherwise(
        F.lit(" # 9")
    )
    return t.events.select("event_id", F.concat(head, F.lit("x"), F.col("event_id").cast("string"), tail).alias("message"))


@query(
    "regex_classify",
    rf"""SELECT event_id, CASE WHEN regexp_matches(m, '^feat(\(|:)\b') THEN 'feature' WHEN regexp_matches(m, '^fix(\(|:)\b') THEN 'fix'
    WHEN regexp_matches(m, '^docs(\(|:)\b') THEN 'docs' WHEN regexp_matches(m, '^refactor(\(|:)\b') THEN 'refactor'
    WHEN regexp_matches(m, '^test(\(|:)\b') THEN 'test' WHEN regexp_matches(m, '^chore(\(|:)\b') THEN 'chore'
    WHEN regexp_matches(m, '^perf(\(|:)\b') THEN 'performance' WHEN regexp_matches(m, '^style(\(|:)\b') THEN 'style'
    WHEN regexp_matches(m, '^ci(\(|:)\b') THEN 'ci' WHEN regexp_matches(m, '^build(\(|:)\b') THEN 'build' ELSE 'other' END AS change_type
    FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events)""",
)
def _regex_classify(t: Tables) -> DataFrame:
    return messages(t).select("event_id", text.change_type(F.col("message")).alias("change_type"))


@query(
    "regex_int_extract",
    f"""SELECT event_id, TRY_CAST(nullif(regexp_extract(m, '#([0-9]+)', 1), '') AS BIGINT) AS request_number
    FROM (SELECT event_id, {_MESSAGE} AS m FROM events)""",
)
def _regex_int_extract(t: Tables) -> DataFrame:
    return messages(t).select("event_id", text.first_int(F.col("message")).alias("request_number"))


@query(
    "part_number_extract",
    """SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') AS BIGINT) AS brand_number,
    lower(p_type) AS part_type FROM part""",
)
def _part_number_extract(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", text.first_int(F.col("p_brand")).alias("brand_number"), F.lower("p_type").alias("part_type")
    )


@query(
    "flags_and_tiers",
    """SELECT c_custkey, c_mktsegment = 'BUILDING' AS is_building,
    (q.quality IS NOT NULL AND q.toxic IS NOT NULL AND q.quality != q.toxic) AS labels_differ,
    q.quality = 1 AS is_good,
    CASE WHEN c_acctbal > 7500 THEN 'High' WHEN c_acctbal > 2500 THEN 'Middle' WHEN c_acctbal > 0 THEN 'Low' ELSE 'Negative' END AS tier,
    c_nationkey IN (1, 7) AS listed_nation, c_nationkey BETWEEN 2 AND 6 AS middle_nation, (c_nationkey < 9 OR c_nationkey > 17) AS outer_nation
    FROM customer LEFT JOIN labels q ON c_custkey = q.doc_id""",
)
def _flags_and_tiers(t: Tables) -> DataFrame:
    df = t.customer.join(t.labels, F.col("c_custkey") == F.col("doc_id"), "left")
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return df.select(
        "c_custkey",
        (F.col("c_mktsegment") == "BUILDING").alias("is_building"),
        keys.both_known_and_differ(F.col("quality"), F.col("toxic")).alias("labels_differ"),
        (F.col("quality") == 1).alias("is_good"),
        first_label([(balance > 7500, "High"), (balance > 2500, "Middle"), (balance > 0, "Low")], "Negative").alias("tier"),
        nation.isin(1, 7).alias("listed_nation"),
        nation.between(2, 6).alias("middle_nation"),
        ((nation < 9) | (nation > 17)).alias("outer_nation"),
    )


@query(
    "null_normalise",
    """SELECT doc_id, nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, '') AS other_lang,
    coalesce(toxic = 1, FALSE) AS is_toxic, coalesce(CAST(quality AS VARCHAR), source, 'none') AS first_known,
    coalesce(quality, 0) AS quality,
    CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE greatest(quality, toxic) END AS strict_greatest
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _null_normalise(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    blanked = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return df.select(
        "doc_id",
        keys.blank_to_null(blanked).alias("other_lang"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_toxic"),
        F.coalesce(F.col("quality").cast("string"), "source", F.lit("none")).alias("first_known"),
        F.coalesce("quality", F.lit(0)).alias("quality"),
        keys.null_safe_greatest(F.col("quality"), F.col("toxic")).alias("strict_greatest"),
    )


@query(
    "required_keys",
    """SELECT doc_id, quality, source FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND coalesce(nullif(source, 'src1'), '') != ''""",
)
def _required_keys(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left").withColumn("named", F.nullif("source", F.lit("src1")))
    return required_rows(df, ["quality"], not_blank=["named"]).select("doc_id", "quality", "source")


@query(
    "array_length",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS n_entries FROM part""",
)
def _array_length(t: Tables) -> DataFrame:
    """Arrays of up to 40 entries; larger parts have no text at all."""
    size = F.col("p_size")
    landed = t.part.select("p_partkey", F.when(size <= 40, F.to_json(F.sequence(F.lit(1), size))).alias("entries"))
    return landed.select("p_partkey", parsing.json_array_size(F.col("entries"), strict=True).alias("n_entries"))


@query(
    "sub_object",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS props_json, 'null' AS missing_json,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def _sub_object(t: Tables) -> DataFrame:
    landed = t.events.select("event_id", F.concat(F.lit('{"p":'), "props", F.lit("}")).alias("data"))
    carried = landed.select(
        "event_id",
        parsing.json_object_text(F.col("data"), "$.p").alias("props_json"),
        parsing.json_object_text(F.col("data"), "$.q").alias("missing_json"),
    )
    return carried.withColumn("k", k_of("props_json"))


@query(
    "text_excerpt",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS excerpt FROM documents""",
)
def _text_excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.excerpt(F.col("text"), 500).alias("excerpt"))


@query(
    "human_bytes",
    r"""SELECT doc_id, regexp_replace(printf('%.2f', round(CASE WHEN s >= 1073741824 THEN s / 1073741824 WHEN s >= 1048576 THEN s / 1048576
      WHEN s >= 1024 THEN s / 1024 ELSE s END, 2)), '\.?0+$', '') || CASE WHEN s >= 1073741824 THEN ' GB' WHEN s >= 1048576 THEN ' MB'
      WHEN s >= 1024 THEN ' KB' ELSE ' Bytes' END AS size_text
    FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * n_chars AS s FROM documents)""",
)
def _human_bytes(t: Tables) -> DataFrame:
    square = F.col("n_chars").cast("double") * F.col("n_chars")
    return t.documents.select("doc_id", text.human_bytes(square).alias("size_text"))


@query(
    "option_parsing",
    """SELECT event_id, 'table' AS materialized, event_type AS unique_key, CAST(user_id AS VARCHAR) AS tags FROM events""",
)
def _option_parsing(t: Tables) -> DataFrame:
    block = F.concat(
        F.lit("\n  materialized='table',\n unique_key = \""), "event_type", F.lit('" ,tags='), F.col("user_id").cast("string")
    )
    parsed = t.events.select("event_id", text.options_map(block).alias("o"))
    return parsed.select("event_id", *[F.col("o").getItem(k).alias(k) for k in ("materialized", "unique_key", "tags")])


@query(
    "name_resolution",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'public' ELSE source END AS schema_name,
    'doc' || CAST(doc_id AS VARCHAR) AS table_name FROM documents""",
)
def _name_resolution(t: Tables) -> DataFrame:
    table = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    name = (
        F.when(F.col("lang") == "en", table)
        .when(F.col("lang") == "fr", F.concat_ws(".", "source", table))
        .otherwise(F.concat_ws(".", "lang", "source", table))
    )
    return t.documents.select("doc_id", text.name_parts(name).alias("n")).select("doc_id", "n.schema_name", "n.table_name")
