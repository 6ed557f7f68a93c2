from __future__ import annotations

import datetime as dt

from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import profile as pr
from tidemark.session import scratch_path
from tidemark.sources import catalog
from tidemark.sources.sinks import render_profiles, write_documents


def profile_of(df, **options):
    return {r.column_name: r for r in pr.column_profile(df, "t", **options).collect()}


def test_numbers_and_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "c")], "n int, s string")
    got = profile_of(df)
    n, s = got["n"], got["s"]
    assert (n.row_count, n.distinct_count, n.null_percentage, n.completeness, n.min_value, n.max_value) == (4, 2, 25.0, 75.0, "1", "2")
    assert n.sample_values == ["1", "2"] and n.data_type == "int" and n.ordinal == 1
    assert s.sample_values == ["c", "a", "b"] and s.min_value is None and s.distinct_count == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "n int, t timestamp_ntz, s string")
    got = profile_of(df)
    assert {(r.row_count, r.distinct_count, r.null_percentage, r.min_value, tuple(r.sample_values)) for r in got.values()} == {(0, 0, 0.0, None, ())}
    assert pr.time_range(df, "t").first()[1:] == ("t", 0, None, None)


def test_all_null_column(spark):
    got = profile_of(spark.createDataFrame([(None,), (None,)], "s string"))["s"]
    assert (got.distinct_count, got.null_percentage, got.sample_values) == (0, 100.0, [])


def test_every_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (0.0D, array(1), map('a', 1), named_struct('x', 1), X'00', DATE'2024-01-01', 1.50BD, true, TIMESTAMP'2024-01-01 00:00:00Z'),
        (-0.0D, array(1), map('a', 1), named_struct('x', 1), X'00', DATE'2024-01-01', 1.50BD, true, TIMESTAMP'2024-01-01 00:00:00Z'),
        (double('NaN'), array(2), map('b', 1), named_struct('x', 2), X'01', DATE'2024-01-02', 2.50BD, false, TIMESTAMP'2024-01-02 00:00:00Z')
        AS t(d, a, m, s, b, day, dec, flag, at)"""
    )
    got = profile_of(df)
    assert {name: r.distinct_count for name, r in got.items()} == dict.fromkeys(df.columns, 2)
    assert got["a"].min_value is None and got["dec"].max_value == "2.50" and got["day"].min_value == "2024-01-01"
    assert got["d"].sample_values[0] == "0.0"


def test_more_than_five_values(spark):
    df = spark.createDataFrame([(c,) for c in "aabbccddeeffg"], "s string")
    assert profile_of(df)["s"].sample_values == list("abcde")
    assert profile_of(df, k=2)["s"].sample_values == ["a", "b"]


def test_long_texts_show_the_right_ones(spark, monkeypatch):
    """Equally common texts that share their start, more of them than are read at once, and copies of some."""
    monkeypatch.setattr(pr, "SETTLED_AT_ONCE", 3)
    monkeypatch.setattr(pr, "NEXT_CHARACTERS", 4)
    monkeypatch.setattr(pr, "MORE", 2)
    start = "a start that all of these texts share, "
    texts = [start + "x" * 40 + f"{i:03d}" for i in range(30)] + [start + c for c in "\uffff\U0001f600"] + ["short", start[:32], start[:33]]
    data = texts + [start + "twice", start + "x" * 40 + "twice", start + "twice", start + "x" * 40 + "twice"]
    df = spark.createDataFrame([(t, bytearray(t.encode()), [t]) for t in data], "s string, b binary, a array<string>").repartition(5)
    got = pr.column_profile(df, "t", k=8).collect()
    want = [start + "twice", start + "x" * 40 + "twice"] + sorted(texts, key=str.encode)[:6]
    assert got[0].sample_values == want and {r.distinct_count for r in got} == {len(texts) + 2}
    assert got[1].sample_values == [t.encode().hex().upper() for t in want]
    assert pr.most_common_values(df, ["s"], 100).count() == len(texts) + 2
    longest = pr.value_histogram(df).agg(F.max(F.length("text")), F.max(F.length("digest"))).first()
    assert tuple(longest) == (pr.SHORT_TEXT, 32)


def test_approximate_is_near(spark):
    df = spark.range(5000)
    assert abs(profile_of(df, approximate=True)["id"].distinct_count - 5000) < 500


def test_time_range_takes_the_first_temporal_column(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), dt.date(2020, 1, 1)), (2, dt.date(2024, 1, 1), None)], "n int, b date, a date")
    assert pr.time_range(df, "t").first() == ("t", "b", 2, "2024-01-01", "2024-01-02")
    assert pr.table_profile(pr.column_profile(df, "t")).first() == ("t", 2, 3, "b", "2024-01-01", "2024-01-02")


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(30)]).write.parquet(path)
    text = plan(pr.column_profile(spark.read.parquet(path), "wide")).split("== Initial Plan ==")[-1]
    assert text.count("FileScan") <= 3
    assert text.count("WindowGroupLimit") == 2


def test_run_goes_on_after_a_failure(spark):
    out = scratch_path(spark, "profiles")

    def broken():
        raise OSError("no such table\nin any folder")

    def silent():
        raise KeyError

    log = pr.profile_tables(spark, {"good": lambda: spark.range(5), "bad": broken, "bare": silent, "best": lambda: spark.range(7)}, out)
    assert [(r.table_name, r.status, r.error) for r in log.orderBy("table_name").collect()] == [
        ("bad", "failed", "OSError: no such table\nin any folder"), ("bare", "failed", "KeyError: "), ("best", "successful", None), ("good", "successful", None)]
    profiles = spark.read.parquet(out)
    assert rows(profiles.select("table_name", "row_count"), "table_name") == [("best", 7), ("good", 5)]


def test_documents(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (None, dt.date(2024, 2, 1))], "n int, day date")
    columns = pr.column_profile(df, "things")
    sizes = spark.createDataFrame([("things", 1536, 1)], "table_name string, size_bytes bigint, file_count bigint")
    pages = render_profiles(columns, pr.table_profile(columns, sizes))
    (page,) = pages.collect()
    for line in ("# public.things", "- **Row Count**: 2", "- **Size**: 1.5 KB", "- **Time Range**: 2024-01-01 to 2024-02-01",
                 "| n | int | Yes | 1 | 50.0% |", "| day | date | Yes | 2 | 0.0% |", "FROM public.things", "LIMIT 10;"):
        assert line in page.document
    out = scratch_path(spark, "pages")
    write_documents(pages, out)
    stored = spark.read.text(f"{out}/schema_name=public/table_name=things", wholetext=True)
    assert stored.first()[0].strip() == page.document.strip()


def test_document_sections(spark):
    columns = pr.column_profile(spark.createDataFrame([(1, "a")], "n int, t string"), "things").unionByName(pr.column_profile(spark.range(2), "bare"))
    models = spark.createDataFrame(
        [("things", {"tags": "daily"}, ["up", "up", "over"], [("raw", "t")]), ("other", {}, [], [])],
        "name string, config map<string,string>, refs array<string>, sources array<struct<source_name: string, table_name: string>>",
    )
    described = spark.createDataFrame([("things", 2, "t", "a text", None), ("things", 1, "n", "", ["unique"])], "table_name string, ordinal int, column_name string, description string, tests array<string>")
    pages = {r.table_name: r.document for r in render_profiles(columns, pr.table_profile(columns), models=models, described=described).collect()}
    assert "- **Materialization**: view\n- **Tags**: daily\n\n**Upstream Dependencies:**\n- `up`\n- `over`\n\n**Sources:**\n- `raw.t`\n\n" in pages["things"]
    assert "## Column Descriptions\n\n### t\n\na text\n\n## Example Query" in pages["things"]
    assert "Model Metadata" not in pages["bare"] and "Column Descriptions" not in pages["bare"]


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    spark.sql("DROP TABLE IF EXISTS shelf.things")
    path = scratch_path(spark, "things")
    catalog.describe(spark.range(3), {"id": "the key"}).write.option("path", path).saveAsTable("shelf.things")
    spark.sql("CREATE OR REPLACE VIEW shelf.seen AS SELECT * FROM shelf.things")
    assert ("shelf",) in rows(catalog.list_schemas(spark))
    assert rows(catalog.list_tables(spark, "shelf")) == [("shelf", "things")]
    inventory = catalog.column_inventory(spark, {"things": spark.table("shelf.things")})
    assert rows(inventory) == [("things", 1, "id", "bigint", True, "the key")]
    assert rows(catalog.row_counts({"things": spark.table("shelf.things")})) == [("things", 3)]
    (size,) = catalog.table_sizes(spark, {"things": path}).collect()
    assert size.size_bytes > 0 and size.file_count >= 1
    spark.sql("DROP DATABASE shelf CASCADE")
