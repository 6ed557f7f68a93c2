"""Graphs, key sets and usage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import Tables, query
from tidemark.operators import graph
from tidemark.operators.graph import Selector
from tidemark.operators.joins import hot_keys, include_exclude, lookup_by_any_name, resolve_edges, spread_join
from tidemark.operators.usage import price_table, run_errors, run_summary, usage_cost


def turn_nodes(t: Tables) -> DataFrame:
    """Conversation turns as nodes, with a path and tags."""
    name = F.concat(F.lit("turn_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return t.conversations.select(
        name.alias("name"),
        "conv_id",
        "turn",
        F.concat("role", F.lit("/"), name, F.lit(".sql")).alias("path"),
        F.array("role", F.lit("turn")).alias("tags"),
        "text",
    )


def turn_edges(t: Tables) -> DataFrame:
    """Each turn leads to the next one of its conversation, and the fourth back to
    the second, so that there are cycles."""
    nodes = turn_nodes(t)
    conv = F.col("conv_id").cast("string")
    follow = nodes.where("turn > 0").select(
        F.concat(F.lit("turn_"), conv, F.lit("_"), (F.col("turn") - 1).cast("string")).alias("src"),
        F.col("name").alias("dst"),
    )
    back = nodes.where("turn = 4").select(
        F.col("name").alias("src"), F.concat(F.lit("turn_"), conv, F.lit("_2")).alias("dst")
    )
    return follow.unionByName(back)


_N = "'turn_' || CAST(conv_id AS VARCHAR) || '_' || CAST({turn} AS VARCHAR)"
_EDGES = f"""edges AS (
  SELECT {_N.format(turn="turn - 1")} AS src, {_N.format(turn="turn")} AS dst FROM conversations WHERE turn > 0
  UNION ALL SELECT {_N.format(turn="turn")}, {_N.format(turn="2")} FROM conversations WHERE turn = 4)"""
_SEEDS = f"seeds AS (SELECT {_N.format(turn='turn')} AS node FROM conversations WHERE role = 'user' AND turn >= 3)"


def seeds(t: Tables) -> DataFrame:
    return turn_nodes(t).where("tags[0] = 'user' AND turn >= 3").select(F.col("name").alias("node"))


@query(
    "graph_upstream",
    f"""WITH RECURSIVE {_EDGES}, {_SEEDS}, reached AS (SELECT node FROM seeds UNION
    SELECT e.src FROM edges e JOIN reached r ON e.dst = r.node) SELECT node FROM reached""",
)
def _graph_upstream(t: Tables) -> DataFrame:
    return graph.upstream(turn_edges(t), seeds(t)).select("node")


@query(
    "graph_downstream",
    f"""WITH RECURSIVE {_EDGES}, {_SEEDS}, reached AS (SELECT node FROM seeds UNION
    SELECT e.dst FROM edges e JOIN reached r ON e.src = r.node) SELECT node FROM reached""",
)
def _graph_downstream(t: Tables) -> DataFrame:
    return graph.downstream(turn_edges(t), seeds(t)).select("node")


@query(
    "graph_both",
    f"""WITH RECURSIVE {_EDGES}, {_SEEDS}, up AS (SELECT node FROM seeds UNION SELECT e.src FROM edges e JOIN up r ON e.dst = r.node),
    down AS (SELECT node FROM seeds UNION SELECT e.dst FROM edges e JOIN down r ON e.src = r.node)
    SELECT node FROM up UNION SELECT node FROM down""",
)
def _graph_both(t: Tables) -> DataFrame:
    return graph.both_directions(turn_edges(t), seeds(t))


@query(
    "graph_changed_downstream",
    f"""WITH RECURSIVE {_EDGES}, changed AS (SELECT {_N.format(turn="turn")} AS node FROM conversations WHERE role = 'system'),
    reached AS (SELECT node FROM changed UNION SELECT e.dst FROM edges e JOIN reached r ON e.src = r.node) SELECT node FROM reached""",
)
def _graph_changed_downstream(t: Tables) -> DataFrame:
    """System turns changed their text between two snapshots."""
    from tidemark.operators.fingerprint import detect_changes, text_fingerprint

    nodes = turn_nodes(t)
    cached = nodes.select("name", text_fingerprint(F.col("text")).alias("logic_hash"))
    edited = F.when(F.col("tags")[0] == "system", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    current = nodes.select("name", text_fingerprint(edited).alias("logic_hash"))
    changes = detect_changes(current, cached, "name", ["logic_hash"])
    return graph.changed_and_downstream(turn_edges(t), changes, "name").select("node")


def model_texts(t: Tables) -> DataFrame:
    """A small query text per order that refers to its customer and its priority."""
    customer = F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))
    text = F.concat(
        F.lit("{{ config(materialized='table', tags='"), "o_orderstatus", F.lit("') }}\nSELECT * FROM {{ ref('"), customer,
        F.lit("') }} a JOIN {{ref(\""), customer, F.lit("\")}} b -- {{ ref( 'spaced' ) }}\n, {{ source('raw', \""), "o_orderpriority", F.lit("\") }}"),
    )
    path = F.concat(F.lit("marts/"), "o_orderstatus", F.lit("/order_"), F.col("o_orderkey").cast("string"), F.lit(".sql"))
    return t.orders.select(path.alias("path"), text.alias("text"))


@query(
    "ref_edges",
    """SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS src, 'order_' || CAST(o_orderkey AS VARCHAR) AS dst, 'model' AS kind, CAST(p AS INTEGER) AS position
    FROM orders, (VALUES (0), (1)) v(p) UNION ALL
    SELECT 'raw.' || o_orderpriority, 'order_' || CAST(o_orderkey AS VARCHAR), 'source', 0 FROM orders""",
)
def _ref_edges(t: Tables) -> DataFrame:
    return graph.model_edges(graph.scan_models(model_texts(t)))


@query(
    "model_options",
    """SELECT 'order_' || CAST(o_orderkey AS VARCHAR) AS name, 'table' AS materialized, o_orderstatus AS tags FROM orders""",
)
def _model_options(t: Tables) -> DataFrame:
    models = graph.scan_models(model_texts(t))
    return models.select("name", *[F.col("config").getItem(k).alias(k) for k in ("materialized", "tags")])


@query(
    "model_totals",
    """SELECT count(*) AS model_count, CAST(2 * count(*) AS BIGINT) AS ref_count, count(*) AS source_count FROM orders""",
)
def _model_totals(t: Tables) -> DataFrame:
    return graph.model_totals(graph.scan_models(model_texts(t)))


@query(
    "model_layers",
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS staging, CAST(0 AS BIGINT) AS intermediate, count(*) AS marts FROM orders""",
)
def _model_layers(t: Tables) -> DataFrame:
    path = F.when(F.col("path").startswith("marts/F/"), F.concat(F.lit("staging/"), "path")).otherwise(F.col("path"))
    return graph.layer_counts(model_texts(t).withColumn("path", path))


@query(
    "models_by_directory",
    """SELECT 'marts/' || o_orderstatus AS directory, count(*) AS n_models, 'order_' || CAST(min(o_orderkey) AS VARCHAR) AS first_model
    FROM orders GROUP BY o_orderstatus""",
)
def _models_by_directory(t: Tables) -> DataFrame:
    models = graph.scan_models(model_texts(t))
    number = F.substring_index("name", "_", -1).cast("bigint")
    return models.groupBy(graph.directory(F.col("path")).alias("directory")).agg(
        F.count("*").alias("n_models"), F.concat(F.lit("order_"), F.min(number).cast("string")).alias("first_model")
    )


@query(
    "items_by_directory",
    """SELECT directory, row_number() OVER (PARTITION BY directory ORDER BY path) AS position, name FROM
    (SELECT 'marts/' || o_orderstatus AS directory, 'order_' || CAST(o_orderkey AS VARCHAR) AS name, directory || '/' || name || '.sql' AS path FROM orders)""",
)
def _items_by_directory(t: Tables) -> DataFrame:
    return graph.items_by_directory(graph.scan_models(model_texts(t)))


@query(
    "select_nodes",
    f"""WITH RECURSIVE {_EDGES}, reached AS (SELECT 'turn_3_2' AS node UNION SELECT e.dst FROM edges e JOIN reached r ON e.src = r.node)
    SELECT name FROM (SELECT {_N.format(turn="turn")} AS name, role || '/' || {_N.format(turn="turn")} || '.sql' AS path, role FROM conversations)
    WHERE (name IN (SELECT node FROM reached) OR regexp_matches(name, '^turn_.*_1$') OR role = 'system' OR regexp_matches(path, 'assistant/.*_5'))
    AND NOT regexp_matches(name, '^turn_2.*$') AND name != 'turn_3_3'""",
)
def _select_nodes(t: Tables) -> DataFrame:
    return graph.select_nodes(
        turn_nodes(t),
        turn_edges(t),
        include=[
            Selector(name="turn_3_2", with_downstream=True),
            Selector(name="turn_*_1"),
            Selector(tag="system"),
            Selector(path="assistant/*_5"),
        ],
        exclude=[Selector(name="turn_2*"), Selector(name="turn_3_3")],
    ).select("name")


@query(
    "name_or_alias",
    """SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer
    ON c_custkey = o_custkey ORDER BY o_orderkey""",
)
def _name_or_alias(t: Tables) -> DataFrame:
    """Even orders ask for a customer by name, odd ones by an alias."""
    number = F.col("o_custkey").cast("string")
    asked = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(number, 9, "0")))
        .otherwise(F.concat(F.lit("alias-"), number))
        .alias("asked"),
    )
    nodes = t.customer.select("c_custkey", "c_name", F.concat(F.lit("alias-"), F.col("c_custkey").cast("string")).alias("alias"))
    return lookup_by_any_name(asked, "asked", nodes, ["c_name", "alias"], "c_custkey").select("o_orderkey", "c_custkey")


@query(
    "dangling_edges",
    """SELECT o_orderkey AS dst, coalesce(c_name, 'customer.' || CAST(o_custkey AS VARCHAR)) AS src, coalesce(c_name, 'unknown') AS src_or_unknown
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""",
)
def _dangling_edges(t: Tables) -> DataFrame:
    key = F.concat(F.lit("customer."), F.col("o_custkey").cast("string"))
    edges = t.orders.select(F.col("o_orderkey").alias("dst"), key.alias("src"), key.alias("src_or_unknown"))
    nodes = t.customer.where("c_acctbal > 0").select(
        F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("id"), "c_name"
    )
    named = resolve_edges(edges, "src", nodes, "id", "c_name")
    return resolve_edges(named, "src_or_unknown", nodes, "id", "c_name", F.lit("unknown"))


@query(
    "set_union",
    """SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""",
)
def _set_union(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return rich.union(t.orders.where("o_orderstatus = 'F'").select("o_custkey")).distinct()


@query(
    "set_difference",
    """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""",
)
def _set_difference(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return include_exclude(t.customer.select(F.col("c_custkey").alias("k")), "k", None, done).distinct()


@query("distinct_set", "SELECT DISTINCT lang, source FROM documents")
def _distinct_set(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()


@query(
    "semi_anti",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _semi_anti(t: Tables) -> DataFrame:
    keys = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    chosen = include_exclude(
        t.orders.select("o_orderkey", "o_custkey"), "o_custkey",
        keys.where("c_acctbal > 0"), keys.where("c_mktsegment = 'BUILDING'"),
    )
    return chosen.select("o_orderkey", "o_custkey")


@query(
    "left_dimension_join",
    """SELECT o_orderkey, o_custkey, last_balance FROM orders LEFT JOIN (SELECT c_custkey, max(c_acctbal) AS last_balance
    FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON c_custkey = o_custkey""",
)
def _left_dimension_join(t: Tables) -> DataFrame:
    dimension = t.customer.where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.max("c_acctbal").alias("last_balance"))
    return spread_join(t.orders.select("o_orderkey", "o_custkey"), dimension, "o_custkey")


@query(
    "skewed_join",
    """SELECT doc_id, l_orderkey, l_linenumber, c_name FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey END AS doc_id FROM lineitem)
    LEFT JOIN (SELECT c_custkey, c_name FROM customer) ON c_custkey = doc_id""",
)
def _skewed_join(t: Tables) -> DataFrame:
    """A quarter of all rows and more on one key, which the sketch finds and the join spreads."""
    key = F.when(F.col("l_linenumber") == 1, F.lit(1).cast("bigint")).otherwise(F.col("l_partkey"))
    rows = t.lineitem.select(key.alias("doc_id"), "l_orderkey", "l_linenumber")
    limit = rows.count() // 10
    return spread_join(rows, t.customer.select(F.col("c_custkey").alias("doc_id"), "c_name"), "doc_id", hot=hot_keys(rows, "doc_id", limit))


_MODEL = """CASE role WHEN 'user' THEN 'claude-3-5-sonnet-20241022' WHEN 'assistant' THEN 'gpt-4o-mini' ELSE 'unknown-model' END"""


def calls(t: Tables) -> DataFrame:
    """Each turn as a call whose tokens are its characters."""
    model = F.when(F.col("role") == "user", "claude-3-5-sonnet-20241022").when(F.col("role") == "assistant", "gpt-4o-mini")
    return t.conversations.select(
        "conv_id",
        "turn",
        "role",
        model.otherwise("unknown-model").alias("model"),
        F.length("text").cast("bigint").alias("input_tokens"),
        (F.length("text") * 2).cast("bigint").alias("output_tokens"),
    )


@query(
    "usage_cost",
    f"""SELECT u.model, calls, input_tokens, output_tokens,
    round(coalesce(input_tokens / 1e6 * p.i + output_tokens / 1e6 * p.o, 0), 9) AS cost FROM (
      SELECT {_MODEL} AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens,
      CAST(sum(2 * length(text)) AS BIGINT) AS output_tokens FROM conversations GROUP BY 1) u
    LEFT JOIN (VALUES ('claude-3-5-sonnet-20241022', CAST(3.0 AS DOUBLE), CAST(15.0 AS DOUBLE)), ('gpt-4o-mini', 0.15, 0.6)) p(model, i, o) ON p.model = u.model""",
)
def _usage_cost(t: Tables) -> DataFrame:
    return usage_cost(calls(t), price_table(t.spark)).withColumn("cost", F.round("cost", 9))


_LOG = """SELECT conv_id AS run_id, CASE role WHEN 'user' THEN 'successful' WHEN 'assistant' THEN 'fallback' ELSE 'failed' END AS status,
  length(text) / 4 AS cost, CAST(turn AS DOUBLE) AS duration, CASE WHEN role = 'system' THEN 'turn ' || CAST(turn AS VARCHAR) END AS error FROM conversations"""


def run_log(t: Tables) -> DataFrame:
    role = F.col("role")
    turn = F.col("turn").cast("string")
    return t.conversations.select(
        F.col("conv_id").alias("run_id"),
        turn.alias("item"),
        F.when(role == "user", "successful").when(role == "assistant", "fallback").otherwise("failed").alias("status"),
        (F.length("text") / 4).alias("cost"),
        F.col("turn").cast("double").alias("duration"),
        F.when(role == "system", F.concat(F.lit("turn "), turn)).alias("error"),
    )


@query(
    "run_summary",
    f"""SELECT run_id, count(*) AS total, count(*) FILTER (status = 'successful') AS successful, count(*) FILTER (status = 'fallback') AS fallback,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(cost) AS total_cost,
    sum(duration) AS total_time, count(error) AS errors FROM ({_LOG}) GROUP BY run_id""",
)
def _run_summary(t: Tables) -> DataFrame:
    return run_summary(run_log(t))


@query(
    "run_errors",
    "SELECT conv_id AS run_id, CAST(turn AS VARCHAR) AS item, 'failed' AS status, 'turn ' || CAST(turn AS VARCHAR) AS error FROM conversations WHERE role = 'system'",
)
def _run_errors(t: Tables) -> DataFrame:
    return run_errors(run_log(t))
