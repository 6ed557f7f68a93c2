from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import fingerprint as fp
from tidemark.operators import graph
from tidemark.operators.graph import Selector
from tidemark.operators.joins import include_exclude, lookup_by_any_name, orphan_keys, resolve_edges, spread_join
from tidemark.operators.quality import NotNull, Relationship, Unique, repeated_values, run_checks
from tidemark.operators.usage import price_table, run_summary, usage_cost
from tidemark.sources.readers import read_texts


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def names(df) -> set:
    return {r[0] for r in df.collect()}


CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("b", "d")]


def seed(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node string")


def test_closure_over_a_cycle(spark):
    edges = edges_of(spark, CYCLE)
    assert names(graph.downstream(edges, seed(spark, "a"))) == set("abcd")
    assert names(graph.upstream(edges, seed(spark, "d"))) == set("abcd")
    assert names(graph.downstream(edges, seed(spark, "d"))) == {"d"}
    assert names(graph.downstream(edges, seed(spark))) == set()


def test_closure_depths_and_limit(spark):
    chain = edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)])
    found = dict(rows(graph.downstream(chain, seed(spark, "n0"))))
    assert found == {f"n{i}": i for i in range(13)}
    assert names(graph.downstream(chain, seed(spark, "n0"), max_depth=3)) == {"n0", "n1", "n2", "n3"}


def test_selectors_share_one_copy_of_the_edges(spark, monkeypatch):
    real, copies = graph.cut_lineage, []

    def watched(df):
        if df.columns == ["src", "dst"]:
            copies.append(df)
        return real(df)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    edges = edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    nodes = spark.createDataFrame([(f"n{i}", f"p/n{i}", []) for i in range(7)], "name string, path string, tags array<string>")
    found = graph.select_nodes(
        nodes, edges, [Selector(name="n2", with_upstream=True, with_downstream=True), Selector(name="n5", with_downstream=True)],
        [Selector(name="n1", with_upstream=True)],
    )
    assert sorted(r.name for r in found.collect()) == ["n2", "n3", "n4", "n5", "n6"]
    assert len(copies) == 1


def test_closure_through_a_hub(spark):
    hub = spark.range(3000).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"))
    back = spark.range(3000).select(F.col("id").cast("string").alias("src"), F.lit("sink").alias("dst"))
    found = graph.downstream(hub.unionByName(back), seed(spark, "hub"))
    assert found.count() == 3002 and found.where("node = 'sink'").first().depth == 2


def test_both_is_not_a_closure_of_closures(spark):
    edges = edges_of(spark, [("up", "x"), ("up", "sibling"), ("x", "down"), ("other", "down")])
    assert names(graph.both_directions(edges, seed(spark, "x"))) == {"up", "x", "down"}


def test_selectors_share_one_traversal(spark, monkeypatch):
    """Seventy directed selectors, more than a word has bits, on chains, a fork and a cycle: as many scans as the longest way has steps, and one more."""
    chains = [(f"a{k}", f"a{k + 1}") for k in range(9)] + [("a4", "b0"), ("b0", "b1"), ("b1", "b0")] + [(f"c{k}", f"c{k + 1}") for k in range(3)]
    edges = spark.createDataFrame(chains, "src string, dst string")
    every = sorted({n for e in chains for n in e})
    nodes = spark.createDataFrame([(n, f"d/{n}", ["x"] if n < "b" else []) for n in every], "name string, path string, tags array<string>")

    def walk(start, up):
        seen, todo = set(start), list(start)
        while todo:
            n = todo.pop()
            for a, b in chains:
                near, far = (b, a) if up else (a, b)
                if near == n and far not in seen:
                    seen.add(far)
                    todo.append(far)
        return seen

    scans, advance = [], graph._advance
    monkeypatch.setattr(graph, "_advance", lambda *args: scans.append(1) or advance(*args))
    ups = [Selector(name="nowhere", with_upstream=True)] * 66 + [Selector(path="d/c1", with_upstream=True), Selector(name="b1", with_upstream=True)]
    got = graph.select_nodes(nodes, edges, [*ups, Selector(name="a3", with_downstream=True)], [Selector(name="b0", with_downstream=True), Selector(tag="x"), Selector(name="c0")])
    want = (walk({"c1"}, True) | walk({"b1"}, True) | walk({"a3"}, False)) - walk({"b0"}, False) - {n for n in every if n < "b"} - {"c0"}
    assert {r["name"] for r in got.collect()} == want == {"c1"}
    assert len(scans) == 7  # a3 is six steps from a9
    scans.clear()
    both = graph.select_nodes(nodes, edges, [Selector(tag="x", with_upstream=True, with_downstream=True), Selector(name="c3", with_upstream=True)], [Selector(name="a7", with_downstream=True)])
    assert {r["name"] for r in both.collect()} == (walk({n for n in every if n < "b"}, False) | walk({"c3"}, True)) - walk({"a7"}, False)
    assert len(scans) == 4


def test_selection(spark):
    nodes = spark.createDataFrame(
        [("stg_a", "staging/stg_a.sql", ["raw"]), ("stg_b", "staging/stg_b.sql", []), ("fct_a", "marts/fct_a.sql", ["raw", "core"])],
        "name string, path string, tags array<string>",
    )
    edges = edges_of(spark, [("stg_a", "fct_a"), ("stg_b", "fct_a"), ("ghost", "stg_a")])

    def pick(include=(), exclude=()):
        return names(graph.select_nodes(nodes, edges, include, exclude).select("name"))

    assert pick() == {"stg_a", "stg_b", "fct_a"}
    assert pick([Selector(name="stg_*")]) == {"stg_a", "stg_b"}
    assert pick([Selector(tag="raw")]) == {"stg_a", "fct_a"}
    assert pick([Selector(path="staging/*")], [Selector(name="stg_b")]) == {"stg_a"}
    assert pick([Selector(name="fct_a", with_upstream=True)]) == {"stg_a", "stg_b", "fct_a"}
    assert pick([Selector(name="stg_a", with_downstream=True)]) == {"stg_a", "fct_a"}
    assert pick([Selector(name="stg_a", with_upstream=True, with_downstream=True)]) == {"stg_a", "fct_a"}
    assert pick([Selector(name="ghost", with_upstream=True)]) == set()
    assert pick([Selector(tag="raw", with_upstream=True)]) == {"stg_a", "stg_b", "fct_a"}
    assert pick([Selector(name="stg_*", with_downstream=True)]) == {"stg_a", "stg_b", "fct_a"}
    for wrong in ({}, {"name": "a", "tag": "b"}):
        with pytest.raises(ValueError):
            Selector(**wrong)
    assert pick([Selector(name="stg_b"), Selector(name="stg_b"), Selector(name="fct_a")]) == {"stg_b", "fct_a"}


def test_model_scan(spark, tmp_path):
    (tmp_path / "staging").mkdir()
    (tmp_path / "base.sql").write_text("SELECT * FROM {{ source(\"raw\", 'table1') }}")
    (tmp_path / "staging" / "stg_users.sql").write_text(
        "{{ config(\n materialized='view'\n) }}\nSELECT * FROM {{ ref(\"base\") }} UNION ALL SELECT * FROM {{ref('base')}} -- {{ ref('a' ) }}"
    )
    models = graph.scan_models(read_texts(spark, str(tmp_path)))
    assert rows(models.select("name", "path", "refs", "config"), "name") == [
        ("base", "base.sql", [], {}),
        ("stg_users", "staging/stg_users.sql", ["base", "base"], {"materialized": "view"}),
    ]
    assert rows(graph.model_edges(models), "dst", "position") == [
        ("raw.table1", "base", "source", 0), ("base", "stg_users", "model", 0), ("base", "stg_users", "model", 1)]
    assert rows(graph.model_totals(models)) == [(2, 2, 1)]
    assert rows(graph.layer_counts(models)) == [(1, 0, 0)]
    assert sorted(rows(models.select(graph.directory(F.col("path"))))) == [(".",), ("staging",)]


def test_fingerprints(spark):
    texts = spark.createDataFrame([("select 1 -- c\n /* x\ny */ from  T",), ("SELECT 1 FROM t",), ("select 2 from t",)], "t string")
    hashes = [r[0] for r in texts.select(fp.text_fingerprint(F.col("t"))).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    docs = spark.createDataFrame([(None, None), ("", ""), ("a", "b"), ("ab", "")], "d string, c string")
    found = [r[0] for r in docs.select(fp.doc_fingerprint(F.col("d"), F.col("c"))).collect()]
    # No description and an empty one are the same; the parts do not run together.
    assert found[0] == found[1] and len(set(found)) == 3


def test_schema_fingerprint_depends_on_order_type_and_nullability(spark):
    ddl = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
    base = [("a", 1, "x", "int", True), ("a", 2, "y", "int", True)]
    others = [("b", 2, "y", "int", True), ("b", 1, "x", "int", True), ("c", 1, "y", "int", True), ("c", 2, "x", "int", True),
              ("d", 1, "x", "int", True), ("d", 2, "y", "int", False), ("e", 1, "x", "bigint", True), ("e", 2, "y", "int", True)]
    got = dict(rows(fp.schema_fingerprint(spark.createDataFrame(base + others, ddl))))
    assert got["a"] == got["b"] and len(set(got.values())) == 4


def test_change_detection(spark):
    ddl = "k string, schema_hash string, documentation_hash string, logic_hash string"
    current = spark.createDataFrame([("same", "1", "1", "1"), ("new", "1", "1", "1"), ("code", "1", "1", "2"), ("doc", "1", None, "1"), ("nulls", None, None, None)], ddl)
    cached = spark.createDataFrame([("same", "1", "1", "1"), ("gone", "1", "1", "1"), ("code", "1", "1", "1"), ("doc", "1", "1", "1"), ("nulls", None, None, None)], ddl)
    got = {r[0]: tuple(r)[1:] for r in fp.detect_changes(current, cached, "k").collect()}
    f, t = False, True
    assert got == {
        "same": (f, f, f, f, f, f), "new": (t, f, t, t, t, t), "gone": (f, t, f, f, f, f),
        "code": (f, f, f, f, t, t), "doc": (f, f, f, t, f, t), "nulls": (f, f, f, f, f, f),
    }


def test_checks(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (2, 9), (None, None)], "id int, fk int")
    parent = spark.createDataFrame([(1,)], "pk int")
    report = run_checks(
        {"child": child, "parent": parent},
        [NotNull("child", "id"), NotNull("child", "fk", "warn"), Unique("child", "id"), Unique("parent", "pk"),
         Relationship("child", "fk", "parent", "pk")],
    )
    got = {(r.check_name, r.table_name, r.column_name): (r.failures, r.status) for r in report.collect()}
    assert got == {
        ("not_null", "child", "id"): (1, "fail"), ("not_null", "child", "fk"): (1, "warn"), ("unique", "child", "id"): (1, "fail"),
        ("unique", "parent", "pk"): (0, "pass"), ("relationships", "child", "fk"): (2, "warn"),
    }
    assert rows(orphan_keys(child, "fk", parent, "pk")) == [(9, 2)]
    assert rows(repeated_values(child, "id")) == [(2, 2)]
    with pytest.raises(ValueError):
        run_checks({}, [])


def test_include_exclude(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    some = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(rows(include_exclude(df, "k", some, some.where("k = 2")))) == [(1,), (1,)]
    assert include_exclude(df, "k", None, None).count() == 4


def test_lookup_by_name_or_alias(spark):
    nodes = spark.createDataFrame([(1, "a", "x"), (2, "b", "a"), (3, "c", None)], "id int, name string, alias string")
    asked = spark.createDataFrame([("a",), ("x",), ("c",), ("zz",)], "q string")
    got = lookup_by_any_name(asked, "q", nodes, ["name", "alias"], "id").select("q", "id", "name")
    assert rows(got, "q") == [("a", 1, "a"), ("c", 3, "c"), ("x", 1, "a"), ("zz", None, None)]


@pytest.mark.parametrize("hot", [[], [1], [1, 5], None])
def test_spread_join_is_the_plain_join(spark, hot):
    # A third of the rows has key 1, another third none.
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 2, F.col("id") % 10).cast("int").alias("k"), "id")
    lookup = spark.createDataFrame([(1, "one"), (5, "five"), (99, "none")], "k int, name string")
    assert sorted(spread_join(df, lookup, "k", "left", hot, salts=7).select("k", "id", "name").collect(), key=str) == sorted(
        df.join(lookup, "k", "left").select("k", "id", "name").collect(), key=str)
    for how in ("left_semi", "left_anti"):
        got = spread_join(df, lookup, "k", how, hot, salts=7).select("k", "id").collect()
        assert sorted(got, key=str) == sorted(df.join(lookup, "k", how).select("k", "id").collect(), key=str)


def test_hot_keys_are_found_and_spread(spark, monkeypatch):
    from tidemark.operators import joins

    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    assert joins.hot_keys(df, "k") == []
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    assert joins.hot_keys(df, "k") == [1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        lookup = spark.createDataFrame([(1, "one")], "k bigint, name string")
        joined = joins.spread_join(df, lookup, "k", hot=joins.hot_keys(df, "k"))
        sizes = joined.where("k = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 6668
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_copies_of_one_row_are_spread(spark):
    from tidemark.operators import joins

    df = spark.range(0, 4000, 1, 40).select(F.lit(1).cast("bigint").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = joins.spread_join(df, spark.createDataFrame([(1, "one")], "k bigint, name string"), "k", hot=[1])
        sizes = joined.where("name = 'one'").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_joins_are_built_without_jobs(spark):
    context = spark.sparkContext
    edges = spark.createDataFrame([("m", "model.a"), ("m", "model.gone")], "dst string, src string")
    nodes = spark.createDataFrame([("model.a", "a")], "id string, name string")
    context.setJobGroup("building joins", "none")
    try:
        include_exclude(edges, "src", nodes.select(F.col("id").alias("src")), None)
        lookup_by_any_name(edges, "src", nodes, ["id", "name"], "id")
        joined = resolve_edges(edges, "src", nodes, "id", "name")
        assert list(context.statusTracker().getJobIdsForGroup("building joins")) == []
        joined.collect()
        assert context.statusTracker().getJobIdsForGroup("building joins")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_items_by_directory(spark):
    models = spark.createDataFrame([("b/x.sql", "x"), ("a/z.sql", "z"), ("a/y.sql", "y"), ("top.sql", "top"), ("a/b/w.sql", "w")], "path string, name string")
    assert rows(graph.items_by_directory(models), "directory", "position") == [(".", 1, "top"), ("a", 1, "y"), ("a", 2, "z"), ("a/b", 1, "w"), ("b", 1, "x")]


def test_dangling_edges(spark):
    edges = spark.createDataFrame([("m", "model.a"), ("m", "model.gone")], "dst string, src string")
    nodes = spark.createDataFrame([("model.a", "a")], "id string, name string")
    assert rows(resolve_edges(edges, "src", nodes, "id", "name"), "src") == [("m", "a"), ("m", "model.gone")]
    assert rows(resolve_edges(edges, "src", nodes, "id", "name", F.lit("unknown")), "src") == [("m", "a"), ("m", "unknown")]


@pytest.mark.parametrize(
    "model, tokens_in, tokens_out, cost",
    [
        ("claude-3-5-sonnet-20241022", 1_000_000, 1_000_000, 18.0),
        ("claude-3-5-haiku-20241022", 1_000_000, 1_000_000, 6.0),
        ("claude-3-5-sonnet-20241022", 100_000, 50_000, 1.05),
        ("claude-3-5-sonnet-20241022", 2_000_000, 500_000, 13.5),
        ("claude-3-5-sonnet-20241022", 0, 0, 0.0),
        ("unknown-model", 1_000_000, 1_000_000, 0.0),
    ],
)
def test_usage_cost(spark, model, tokens_in, tokens_out, cost):
    half = (model, tokens_in // 2, tokens_out // 2)
    usage = spark.createDataFrame([half, half], "model string, input_tokens bigint, output_tokens bigint")
    (row,) = usage_cost(usage, price_table(spark)).collect()
    assert (row.calls, row.cost) == (2, pytest.approx(cost))


def test_run_summary(spark):
    log = spark.createDataFrame(
        [("r", "successful", 1.0, 2.0, None), ("r", "failed", None, 1.0, "e"), ("r", "fallback", 0.5, None, "f"), ("q", None, None, None, None)],
        "run_id string, status string, cost double, duration double, error string",
    )
    assert rows(run_summary(log), "run_id") == [("q", 1, 0, 0, 0, 0, 0.0, 0.0, 0), ("r", 3, 1, 1, 1, 0, 1.5, 3.0, 2)]
