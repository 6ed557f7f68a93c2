from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import keys, measures, parsing, text
from tidemark.functions.calendar import calendar_columns, days_before, utc_wall_time, whole_days
from tidemark.operators import textmine as tm


def one(spark, values, expression, ddl="v string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ddl)
    return [r[0] for r in df.select(expression).collect()]


def test_change_type_keeps_the_word_boundary(spark):
    cases = {
        "feat: add x": "other", "feat(api): x": "feature", "feat:x": "feature", "fix!: x": "other",
        "FIX(core)": "fix", "perf (x)": "other", "docs(: )": "other", "perf:é": "other", None: "other",
    }
    assert one(spark, cases, text.change_type(F.col("v"))) == list(cases.values())


def test_first_int(spark):
    assert one(spark, ["Fix bug (#123) see #9", "none", None, "# 9"], text.first_int(F.col("v"))) == [123, None, None, None]


def test_safe_casts(spark):
    assert one(spark, ["12.7", "0x1A", " 12 ", "junk", "-3"], parsing.safe_int(F.col("v"))) == [None, None, 12, None, -3]
    assert one(spark, ["TRUE", "yes", "false", "1", None], parsing.safe_bool(F.col("v"))) == [True, None, False, None, None]
    stamps = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05.123456789+02:00",
              "2024-01-02", "2024-01-02T03:04:05", "junk"]
    found = one(spark, stamps, parsing.safe_timestamp(F.col("v")).cast("timestamp_ntz"))
    assert found == [
        dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120000),
        dt.datetime(2024, 1, 2, 1, 4, 5, 123456), None, None, None,
    ]


def test_json_scalar_has_no_text_for_nested_values(spark):
    values = ['{"a":"[1] x"}', '{"a":[1]}', '{"a":{"b":1}}', '{"a":null}', '{"a":true}', "{}", "junk", None]
    assert one(spark, values, parsing.json_scalar(F.col("v"), "$.a")) == ["[1] x", None, None, None, "true", None, None, None]


def test_json_array_size(spark):
    values = ['["a","b"]', "[]", None, "{}"]
    assert one(spark, values, parsing.json_array_size(F.col("v"))) == [2, 0, 0, 0]
    with pytest.raises(Exception, match="not a JSON array"):
        one(spark, ["{}"], parsing.json_array_size(F.col("v"), strict=True))


def test_surrogate_key_and_label(spark):
    df = spark.createDataFrame([(None, "r", 5, "b"), ("o", "r", None, "b")], "org string, repo string, id bigint, branch string")
    found = df.select(keys.surrogate_key(["org", "repo", "id", "branch"], ["/", ":", ":"]), keys.label("org", "repo"))
    assert [tuple(r) for r in found.collect()] == [("/r:5:b", None), ("o/r::b", "o/r")]
    with pytest.raises(ValueError):
        keys.surrogate_key(["org", "repo"], [])


def test_both_known_and_differ(spark):
    pairs = [("a", "a"), ("a", "b"), ("a", None), (None, None)]
    assert one(spark, pairs, keys.both_known_and_differ(F.col("x"), F.col("y")), "x string, y string") == [False, True, False, False]


def test_null_safe_greatest(spark):
    pairs = [(0, 1), (None, 1), (7, 1)]
    assert one(spark, pairs, keys.null_safe_greatest(F.col("x"), F.col("y")), "x int, y int") == [1, None, 7]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 10),), (dt.datetime(2024, 5, 7),)], "ts timestamp_ntz")
    got = df.select(*[c.alias(n) for n, c in calendar_columns(F.col("ts"), "c").items()]).collect()
    d = dt.date
    assert tuple(got[0]) == (d(2024, 1, 7), d(2024, 1, 1), d(2024, 1, 1), d(2024, 1, 1), d(2024, 1, 1), 1, 10)
    assert got[1].c_quarter == d(2024, 4, 1)


def test_calendar_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT timestamp '2024-01-07 23:30:00Z' AS ts")
        assert df.select(F.hour(utc_wall_time(df, "ts")), utc_wall_time(df, "ts").cast("date").cast("string")).first() == (23, "2024-01-07")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_whole_days_floor_seconds_and_truncate(spark):
    rows_ = [
        (dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 2, 0, 0, 0, 100000)),
        (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 12)),
        (dt.datetime(1969, 12, 31, 23, 59, 59, 500000), dt.datetime(1970, 1, 1, 23, 59, 59)),
        (None, dt.datetime(2024, 1, 1)),
    ]
    got = one(spark, rows_, whole_days(F.col("a"), F.col("b")), "a timestamp_ntz, b timestamp_ntz")
    assert got == [1, 0, 1, None]


def test_days_before(spark):
    got = one(spark, [dt.datetime(2024, 3, 31, 5)], days_before(F.col("v"), 30), "v timestamp_ntz")
    assert got == [dt.datetime(2024, 3, 1, 5)]


def test_ratios(spark):
    pairs = [(1, 3), (5, 0)]
    assert one(spark, pairs, measures.percent(F.col("a"), F.col("b")), "a int, b int") == [33.33, None]
    assert one(spark, [(5, 0)], measures.ratio(F.col("a"), keys.null_safe_greatest(F.col("b"), F.lit(1))), "a int, b int") == [5.0]


def test_human_bytes(spark):
    values = [0, 1, 1024, 1536, 220511, 1048576, 10, 100, 5 * 1024**4, 3000 * 1024**4, None]
    assert one(spark, values, text.human_bytes(F.col("v")), "v bigint") == [
        "0 Bytes", "1 Bytes", "1 KB", "1.5 KB", "215.34 KB", "1 MB", "10 Bytes", "100 Bytes", "5 TB", "3000 TB", None,
    ]


def test_options_map(spark):
    block = "\n materialized='incremental',\n unique_key = \"sha\", enabled=true, n=3, tags=['a', 'b'], n=4"
    (found,) = one(spark, [block], text.options_map(F.col("v")))
    # The split at every comma cuts the list in two; the second half has no key.
    assert found == {"materialized": "incremental", "unique_key": "sha", "enabled": "true", "tags": "['a'", "n": "4"}


def test_name_parts(spark):
    values = ["db.s.t", "s.t", "t", "a.b.c.d"]
    found = one(spark, values, text.name_parts(F.col("v")))
    assert [tuple(r) for r in found] == [("s", "t"), ("s", "t"), ("public", "t"), ("public", "a.b.c.d")]


def test_html_to_text(spark):
    page = "<html><STYLE type=x>p{}</STYLE><p>One&amp; \n two</p><script>if (a<b) {}\n</script>three<scripty>4</html>"
    assert one(spark, [page], text.html_to_text(F.col("v"))) == ["One&amp; two three 4"]
    long = "<p>" + "x" * 6000
    assert one(spark, [long], text.html_to_text(F.col("v"), cap=5000)) == ["x" * 5000 + "..."]
    assert one(spark, [long], F.length(text.html_to_text(F.col("v")))) == [6000]


def test_unclosed_script_stays(spark):
    assert one(spark, ["<script>a b"], text.html_to_text(F.col("v"))) == ["a b"]


def test_normalise_sql(spark):
    values = ["select 1 -- c\n /* x\ny */ from  T", "SELECT 1 FROM t"]
    assert one(spark, values, text.normalise_sql(F.col("v"))) == ["select 1 from t"] * 2


def test_comments(spark):
    (found,) = one(spark, ["a -- one two \n/* b\n c */ d --\n e"], text.comments(F.col("v")))
    # An empty line comment runs on into the next line, as white space is skipped.
    assert found == ["one two ", "e", "b\n c"]


def test_terms(spark):
    (found,) = one(spark, ["The Great Orders Table is Big and Net  Revenue, Eauoué, Table of Net  Revenue"], tm.term_array(F.col("v")))
    assert found == ["The Great Orders", "Net  Revenue", "Eauou"]


def test_domains(spark):
    values = ["fct_orders", "stg_shopify_orders", "orders", "stg_github_commits"]
    assert one(spark, values, tm.domain_of(F.col("v"))) == ["orders", "shopify orders", None, "github commits"]
    assert one(spark, values, tm.second_token(F.col("v"))) == [None, "shopify", None, "github"]


def test_metric_names(spark):
    values = ["total_x", "x_REVENUE", "mrr_now", "Churned", "orders", "subtotal_x", "x_values"]
    assert one(spark, values, tm.is_metric_name(F.col("v"))) == [True, True, True, True, False, False, False]


def test_vocabulary(spark):
    df = spark.createDataFrame(
        [(1, "Orders"), (1, "Ledger"), (2, "MRR"), (3, None), (3, "order"), (4, "Leads"), (4, "payments")], "k int, w string"
    )
    assert rows(tm.vocabulary_by_key(df, ["k"], "w"), "k") == [(1, "E-commerce"), (2, "SaaS"), (3, "General"), (4, "Finance")]
    listed = df.groupBy("k").agg(F.collect_list("w").alias("w")).select("k", tm.vocabulary_of(F.col("w")))
    assert rows(listed, "k") == [(1, "E-commerce"), (2, "SaaS"), (3, "General"), (4, "Finance")]
