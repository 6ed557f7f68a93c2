"""Table and column profiles, catalog reports, data checks and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import Tables, query
from tidemark.functions.text import normalise_sql
from tidemark.operators import fingerprint as fp
from tidemark.operators import profile as pr
from tidemark.operators.joins import column_lookup, orphan_keys
from tidemark.operators.quality import NotNull, Relationship, Unique, null_rows, repeated_values, run_checks
from tidemark.operators.ranking import global_rank, top_k
from tidemark.plans.profile_sync import sync_profiles
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import catalog
from tidemark.sources.sinks import render_profiles

ALL = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def _per_column(table: str, columns: list[str], body: str) -> str:
    """The same SELECT for every column; {c} is the column, {t} the table."""
    return " UNION ALL ".join(body.format(c=c, t=table) for c in columns)


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(*_LABELLED)


_LABELLED_SQL = "(SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(
    "profile_columns",
    _per_column(
        _LABELLED_SQL,
        _LABELLED,
        """SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(*) AS row_count,
        count(*) - count({c}) AS null_count, 100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_percentage FROM {t}""",
    ),
)
def _profile_columns(t: Tables) -> DataFrame:
    df = labelled(t)
    basics = pr.column_basics(df).select("column_name", "row_count", "null_count", "null_percentage")
    distinct = pr.distinct_values(df)
    return basics.join(distinct, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))


# Columns with a range; None stands for one without.
_KINDS = {
    "customer": {"c_custkey": "bigint", "c_name": None, "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": None},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": None, "value": "double", "props": None},
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": None, "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": None,
    },
}


def _shown(kind: str | None, value: str) -> str:
    """The text of a value, in SQL; NULL for a kind without a range."""
    if kind is None:
        return "CAST(NULL AS VARCHAR)"
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp_ntz" else f"CAST({value} AS VARCHAR)"


def _range_sql(table: str, column: str, kind: str | None) -> str:
    ends = []
    for end in ("min", "max"):
        real = kind == "double"
        ends.append(f"{_shown(None if real else kind, f'{end}({column})')} AS {end}_value, {f'{end}({column})' if real else 'CAST(NULL AS DOUBLE)'} AS {end}_real")
    rows = table if kind else f"(SELECT count(*) FROM {table})"
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, {', '.join(ends)} FROM {rows}"


@query(
    "profile_minmax",
    " UNION ALL ".join(_range_sql(table, c, kind) for table, columns in _KINDS.items() for c, kind in columns.items()),
)
def _profile_minmax(t: Tables) -> DataFrame:
    """All columns; the ends of float columns are compared as numbers."""
    parts = []
    for table in _KINDS:
        real = F.col("data_type") == "double"
        ends = {f"{end}_value": F.when(~real, F.regexp_replace(f"{end}_value", r"\.\d+$", "")) for end in ("min", "max")}
        reals = {f"{end}_real": F.when(real, F.col(f"{end}_value").try_cast("double")) for end in ("min", "max")}
        basics = pr.column_basics(getattr(t, table)).withColumns({**ends, **reals})
        parts.append(basics.select(F.lit(table).alias("table_name"), "column_name", *ends, *reals))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _top_sql(table: str, column: str, kind: str | None = "text") -> str:
    """The most common values of a column, ties by value."""
    return f"""SELECT '{column}' AS column_name, CAST(rn AS INTEGER) AS value_rank, {_shown(kind or "text", "value")} AS value, n FROM (
        SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rn FROM (
          SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY ALL)) WHERE rn <= 5"""


def _samples_sql(table: str, kinds: dict) -> str:
    tops = " UNION ALL ".join(_top_sql(table, c, kind) for c, kind in kinds.items())
    return f"SELECT column_name, string_agg(value, ',' ORDER BY value_rank) AS sample_values FROM ({tops}) GROUP BY column_name"


def _full_profile_sql(table: str, kinds: dict) -> str:
    """Everything a column profile holds; ``kinds`` gives each column's type and whether it has a range."""
    columns = " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, CAST({i + 1} AS INTEGER) AS ordinal, '{c}' AS column_name, '{kind or "string"}' AS data_type, TRUE AS nullable,
        count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, 100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_percentage,
        100.0 - 100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS completeness,
        {_shown(kind, f"min({c})")} AS min_value, {_shown(kind, f"max({c})")} AS max_value FROM {table}"""
        for i, (c, kind) in enumerate(kinds.items())
    )
    return f"SELECT b.*, s.sample_values FROM ({columns}) b LEFT JOIN ({_samples_sql(table, kinds)}) s USING (column_name)"


def full_profile(df: DataFrame, name: str) -> DataFrame:
    return pr.column_profile(df, name).withColumn("sample_values", F.array_join("sample_values", ","))


@query("profile_top_values", " UNION ALL ".join(_top_sql("orders", c, kind) for c, kind in _KINDS["orders"].items()))
def _profile_top_values(t: Tables) -> DataFrame:
    return pr.most_common_values(t.orders)


@query(
    "profile_time_range",
    """SELECT 'events' AS table_name, 'ts' AS time_column, count(*) AS row_count, strftime(min(ts), '%Y-%m-%d %H:%M') AS min_date,
    strftime(max(ts), '%Y-%m-%d %H:%M') AS max_date FROM events UNION ALL
    SELECT 'customer', NULL, count(*), NULL, NULL FROM customer""",
)
def _profile_time_range(t: Tables) -> DataFrame:
    found = pr.time_range(t.events, "events").unionByName(pr.time_range(t.customer, "customer"))
    return found.withColumns({c: F.substring(c, 1, 16) for c in ("min_date", "max_date")})


@query("column_profile", _full_profile_sql("orders", _KINDS["orders"]))
def _column_profile(t: Tables) -> DataFrame:
    return full_profile(t.orders, "orders")


@query("column_samples", _samples_sql("documents", {"doc_id": "bigint", "text": None, "lang": None, "source": None, "n_chars": "bigint"}))
def _column_samples(t: Tables) -> DataFrame:
    """All columns, whole texts among them."""
    return full_profile(t.documents, "documents").select("column_name", "sample_values")


_LINES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": None, "l_linestatus": None,
    "l_shipdate": "timestamp_ntz",
}


@query("lineitem_profile", _full_profile_sql("lineitem", _LINES))
def _lineitem_profile(t: Tables) -> DataFrame:
    """All columns of the largest table."""
    return full_profile(t.lineitem, "lineitem")


@query(
    "table_profile",
    """SELECT 'orders' AS table_name, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'o_orderdate' AS time_column,
    strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date FROM orders
    UNION ALL SELECT 'customer', count(*), 5, NULL, NULL, NULL FROM customer""",
)
def _table_profile(t: Tables) -> DataFrame:
    columns = pr.column_profile(t.orders, "orders").unionByName(pr.column_profile(t.customer, "customer"))
    return pr.table_profile(columns)


_PAGE_START = (
    """SELECT 'public' AS schema_name, 'orders' AS table_name, '# public.orders' || chr(10) || chr(10) || '## Table Information' || chr(10) || chr(10)
    || '- **Database**: public' || chr(10) || '- **Table**: orders' || chr(10) || '- **Row Count**: ' || format('{:,}', count(*)) || chr(10)
    || '- **Time Range**: ' || strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')
    || chr(10) || chr(10) || '## Schema' || chr(10) || chr(10) || '| Column | Type | Nullable | Distinct | Null % |' || chr(10) || '|---|---|---|---|---|' || chr(10) || """
    + " || chr(10) || ".join(
        f"'| {c} | {kind} | Yes | ' || format('{{:,}}', count(DISTINCT {c})) || ' | 0.0% |'"
        for c, kind in zip(_ORDERS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"])
    )
)
_PAGE_END = """ || chr(10) || chr(10) || '## Example Query' || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT *' || chr(10) || 'FROM public.orders'
    || chr(10) || 'LIMIT 10;' || chr(10) || '```' || chr(10) AS document FROM orders"""


@query("profile_documents", _PAGE_START + _PAGE_END)
def _profile_documents(t: Tables) -> DataFrame:
    """One rendered page per profiled table."""
    columns = cut_lineage(pr.column_profile(t.orders, "orders"))
    return render_profiles(columns, pr.table_profile(columns))


_MODEL_SECTIONS = """ || chr(10) || chr(10) || '## dbt Model Metadata' || chr(10) || chr(10) || '- **Materialization**: table' || chr(10) || '- **Tags**: ' || min(o_orderstatus)
    || chr(10) || '- **Description**: all orders' || chr(10) || chr(10) || '**Upstream Dependencies:**' || chr(10)
    || (SELECT string_agg('- `' || o_orderpriority || '`', chr(10) ORDER BY o_orderpriority) FROM (SELECT DISTINCT o_orderpriority FROM orders))
    || chr(10) || chr(10) || '**Sources:**' || chr(10)
    || (SELECT string_agg('- `raw.' || o_orderstatus || '`', chr(10) ORDER BY o_orderstatus) FROM (SELECT DISTINCT o_orderstatus FROM orders))
    || chr(10) || chr(10) || '## Column Descriptions' || chr(10) || chr(10) || '### o_orderkey' || chr(10) || chr(10) || 'the key' || chr(10) || chr(10)
    || '**Tests**: not_null, unique' || chr(10) || chr(10) || '### o_orderdate' || chr(10) || chr(10) || 'day of the order'"""


@query("model_documents", _PAGE_START + _MODEL_SECTIONS + _PAGE_END)
def _model_documents(t: Tables) -> DataFrame:
    """A page with its model's metadata, dependencies and column descriptions; both lists hold one entry per status or priority."""
    columns = cut_lineage(pr.column_profile(t.orders, "orders"))
    source = F.transform(F.sort_array(F.collect_set("o_orderstatus")), lambda s: F.struct(F.lit("raw").alias("source_name"), s.alias("table_name")))
    model = t.orders.agg(
        F.lit("orders").alias("name"), F.lit("all orders").alias("description"), F.sort_array(F.collect_set("o_orderpriority")).alias("refs"),
        source.alias("sources"), F.create_map(F.lit("materialized"), F.lit("table"), F.lit("tags"), F.min("o_orderstatus")).alias("config"),
    )
    described = t.spark.createDataFrame(
        [("orders", 5, "o_orderdate", "day of the order", []), ("orders", 1, "o_orderkey", "the key", ["not_null", "unique"]), ("orders", 2, "o_custkey", None, ["not_null"])],
        "table_name string, ordinal int, column_name string, description string, tests array<string>",
    )
    return render_profiles(columns, pr.table_profile(columns), models=cut_lineage(model), described=described)


@query(
    "column_inventory",
    """SELECT c.table_name, CAST(row_number() OVER (PARTITION BY c.table_name ORDER BY c.column_index) AS INTEGER) AS ordinal,
    c.column_name, CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
      WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' WHEN 'FLOAT[]' THEN 'array<float>' ELSE c.data_type END AS data_type,
    c.is_nullable AS nullable, CASE c.column_name WHEN 'doc_id' THEN 'key of ' || c.table_name END AS description, r.row_count
    FROM duckdb_columns() c JOIN ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ALL)
    + ") r ON r.table_name = c.table_name WHERE NOT c.internal",
)
def _column_inventory(t: Tables) -> DataFrame:
    """All columns of all tables, one of them described."""
    tables = {n: getattr(t, n) for n in ALL}
    tables = {n: catalog.describe(df, {"doc_id": f"key of {n}"} if "doc_id" in df.columns else {}) for n, df in tables.items()}
    return catalog.column_inventory(t.spark, tables).join(catalog.row_counts(tables), "table_name")


@query(
    "table_size",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, TRUE AS has_files, TRUE AS has_bytes FROM {n}" for n in ALL),
)
def _table_size(t: Tables) -> DataFrame:
    """Rows of all tables, and whether their files were found; SQL cannot see files, so tests compare the bytes."""
    counts = catalog.row_counts({n: getattr(t, n) for n in ALL})
    sizes = catalog.table_sizes(t.spark, {n: t.path(n) for n in ALL})
    found = sizes.select("table_name", (F.col("file_count") > 0).alias("has_files"), (F.col("size_bytes") > 0).alias("has_bytes"))
    return counts.join(found, "table_name")


@query(
    "column_docs",
    """SELECT column_name, n, 'a ' || column_name AS description FROM (SELECT event_type AS column_name, count(*) AS n FROM events GROUP BY ALL)
    WHERE column_name < 'd' UNION ALL SELECT event_type, count(*), NULL FROM events WHERE event_type >= 'd' GROUP BY ALL""",
)
def _column_docs(t: Tables) -> DataFrame:
    names = t.events.groupBy(F.col("event_type").alias("column_name")).agg(F.count("*").alias("n"))
    docs = t.events.select(F.col("event_type").alias("column_name")).distinct().where("column_name < 'd'")
    docs = docs.withColumn("description", F.concat(F.lit("a "), "column_name"))
    return column_lookup(names, docs, ["column_name"])


@query(
    "dq_not_null",
    "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
)
def _dq_not_null(t: Tables) -> DataFrame:
    return null_rows(labelled(t), "quality").select("doc_id", "lang")


@query(
    "dq_unique",
    "SELECT text, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
)
def _dq_unique(t: Tables) -> DataFrame:
    return repeated_values(t.documents, "text")


@query(
    "dq_relationships",
    """SELECT l_suppkey, count(*) AS n_rows FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (
    SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY l_suppkey""",
)
def _dq_relationships(t: Tables) -> DataFrame:
    """Only suppliers with a high balance count as parents, so that there are orphans."""
    return orphan_keys(t.lineitem, "l_suppkey", t.supplier.where("s_acctbal > 5000"), "s_suppkey")


@query(
    "dq_report",
    """SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM (
    SELECT 'documents' AS table_name, 'not_null' AS check_name, 'doc_id' AS column_name, 'error' AS severity,
      count(*) FILTER (doc_id IS NULL) AS failures FROM documents
    UNION ALL SELECT 'documents', 'not_null', 'quality', 'warn', count(*) FILTER (quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'documents', 'unique', 'doc_id', 'error', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'documents', 'unique', 'text', 'error', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'orders', 'relationships', 'o_custkey', 'warn', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'documents', 'relationships', 'doc_id', 'error', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)))""",
)
def _dq_report(t: Tables) -> DataFrame:
    tables = {
        "documents": t.documents.join(t.labels, "doc_id", "left"),
        "labels": t.labels,
        "orders": t.orders,
        "customer": t.customer,
    }
    return run_checks(
        tables,
        [
            NotNull("documents", "doc_id"),
            NotNull("documents", "quality", severity="warn"),
            Unique("documents", "doc_id"),
            Unique("documents", "text"),
            Relationship("orders", "o_custkey", "customer", "c_custkey"),
            Relationship("documents", "doc_id", "labels", "doc_id", severity="error"),
        ],
    )


@query(
    "schema_fingerprint",
    """SELECT f.table_name, sha256(f.text) AS schema_hash, r.row_count FROM (VALUES
    ('region', 'r_regionkey:int:true|r_name:string:true'),
    ('labels', 'doc_id:bigint:true|quality:int:true|toxic:int:true'),
    ('events', 'event_id:bigint:true|ts:timestamp_ntz:true|user_id:bigint:true|event_type:string:true|value:double:true|props:string:true')
    ) AS f(table_name, text) JOIN (SELECT 'region' AS table_name, count(*) AS row_count FROM region UNION ALL
    SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events) r USING (table_name)""",
)
def _schema_fingerprint(t: Tables) -> DataFrame:
    """Fingerprints next to the rows they describe."""
    tables = {n: getattr(t, n) for n in ("region", "labels", "events")}
    prints = fp.schema_fingerprint(catalog.column_inventory(t.spark, tables))
    return prints.join(catalog.row_counts(tables), "table_name")


_CODE = r"""'SELECT ' || lang || ' -- note ' || source || chr(10) || '/* ' || source || chr(10) || ' */ FROM   T' || CAST(n_chars AS VARCHAR) || '  '"""


def code_texts(t: Tables) -> DataFrame:
    """A small query text per document, with both forms of comments."""
    code = F.concat(
        F.lit("SELECT "), "lang", F.lit(" -- note "), "source", F.lit("\n/* "), "source", F.lit("\n */ FROM   T"),
        F.col("n_chars").cast("string"), F.lit("  "),
    )
    return t.documents.select("doc_id", "lang", "source", "n_chars", code.alias("code"))


@query(
    "text_fingerprint",
    f"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(code, '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g'))) AS normalised,
    sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(code, '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g')))) AS logic_hash
    FROM (SELECT doc_id, {_CODE} AS code FROM documents)""",
)
def _text_fingerprint(t: Tables) -> DataFrame:
    code = F.col("code")
    return code_texts(t).select("doc_id", normalise_sql(code).alias("normalised"), fp.text_fingerprint(code).alias("logic_hash"))


@query(
    "doc_fingerprint",
    """SELECT doc_id, sha256(text || chr(31) || lang || chr(31) || coalesce(CAST(quality AS VARCHAR), '')) AS documentation_hash
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _doc_fingerprint(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    hashed = fp.doc_fingerprint(F.col("text"), F.col("lang"), F.col("quality"))
    return df.select("doc_id", hashed.alias("documentation_hash"))


def fingerprints(code: DataFrame, comment: str, source: str) -> DataFrame:
    return code.select(
        "doc_id",
        F.sha2("lang", 256).alias("schema_hash"),
        fp.doc_fingerprint(F.col(source)).alias("documentation_hash"),
        fp.text_fingerprint(F.concat("code", F.lit(comment))).alias("logic_hash"),
    )


def change_flags(t: Tables) -> DataFrame:
    """Two snapshots: in the current one, English documents are new, French ones
    are gone, labelled ones have another description and large ones another code."""
    code = code_texts(t).join(t.labels, "doc_id", "left")
    cached = fingerprints(code.where("lang != 'en'"), "", "source")
    changed = code.withColumns(
        {
            "source": F.when(F.col("quality") == 1, F.lit("changed")).otherwise(F.col("source")),
            "code": F.when(F.col("n_chars") > 1000, F.concat("code", F.lit(" where 1=1"))).otherwise(F.col("code")),
        }
    )
    current = fingerprints(changed.where("lang != 'fr'"), " -- only a comment", "source")
    return fp.detect_changes(current, cached, "doc_id")


@query(
    "change_detect",
    """SELECT doc_id, lang = 'en' AS is_new, lang = 'fr' AS is_removed, lang = 'en' AS schema_changed,
    lang = 'en' OR (lang != 'fr' AND coalesce(quality = 1, FALSE)) AS documentation_changed,
    lang = 'en' OR (lang != 'fr' AND n_chars > 1000) AS logic_changed,
    lang = 'en' OR (lang != 'fr' AND (coalesce(quality = 1, FALSE) OR n_chars > 1000)) AS should_reprofile
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _change_detect(t: Tables) -> DataFrame:
    return change_flags(t)


_PROFILED = ("2024-03-01 00:00:00", "2024-04-01 00:00:00")
_REPROFILED = "lang = 'en' OR (lang != 'fr' AND (coalesce(quality = 1, FALSE) OR n_chars > 1000))"


@query(
    "fingerprint_store",
    f"""SELECT doc_id, lang AS table_name, sha256(lang) AS schema_hash,
    sha256(text || chr(31) || 'lang' || chr(30) || lang || chr(29) || 'source' || chr(30)
      || CASE WHEN lang != 'fr' AND quality = 1 THEN 'changed' ELSE coalesce(source, '') END) AS documentation_hash,
    sha256('select ' || lower(lang) || ' from t' || CAST(n_chars AS VARCHAR) || CASE WHEN lang != 'fr' AND n_chars > 1000 THEN ' where 1=1' ELSE '' END) AS logic_hash,
    CASE WHEN {_REPROFILED} THEN TIMESTAMP '{_PROFILED[1]}' ELSE TIMESTAMP '{_PROFILED[0]}' END AS last_profiled_at
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _fingerprint_store(t: Tables) -> DataFrame:
    """Two snapshots as for ``change_detect``, each compared with the stored fingerprints; the store's end state."""
    code = code_texts(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.labels, "doc_id", "left")
    changed = code.withColumns(
        {
            "source": F.when(F.col("quality") == 1, F.lit("changed")).otherwise(F.col("source")),
            "code": F.when(F.col("n_chars") > 1000, F.concat("code", F.lit(" where 1=1"))).otherwise(F.col("code")),
        }
    )

    def prints(rows: DataFrame) -> DataFrame:
        described = [F.struct(F.lit(c).alias("name"), F.col(c).alias("description")) for c in ("source", "lang")]
        return rows.select(
            "doc_id", F.col("lang").alias("table_name"), F.sha2("lang", 256).alias("schema_hash"),
            fp.doc_fingerprint(F.col("text"), fp.listed_columns(F.array(*described))).alias("documentation_hash"),
            fp.text_fingerprint(F.col("code")).alias("logic_hash"),
        )

    path = scratch_path(t.spark, "fingerprints")
    for rows, at in zip((code.where("lang != 'en'"), changed.where("lang != 'fr'")), _PROFILED):
        fp.store_fingerprints(path, prints(rows), "doc_id", F.lit(at).cast("timestamp_ntz"))
    return fp.stored_fingerprints(t.spark, path)


@query(
    "global_rank",
    """SELECT o_custkey, total, row_number() OVER (ORDER BY total DESC, o_custkey) AS spend_rank
    FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY ALL)""",
)
def _global_rank(t: Tables) -> DataFrame:
    """Split over several sorted ranges even at this size."""
    totals = cut_lineage(t.orders.groupBy("o_custkey").agg(F.count("*").alias("total")))
    rows = totals.count()
    return global_rank(totals, [F.desc("total"), F.asc("o_custkey")], "spend_rank", rows, max(1, rows // 4))


@query(
    "top_k",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5",
)
def _top_k(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("o_custkey")], 5)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _preview(t: Tables) -> DataFrame:
    return top_k(t.orders, [F.asc("o_orderkey")], 10)


@query(
    "total_order",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def _total_order(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


_DOCUMENTS = {"doc_id": "bigint", "text": None, "lang": None, "source": None, "n_chars": "bigint"}


@query("documents_profile", _full_profile_sql("documents", _DOCUMENTS))
def _documents_profile(t: Tables) -> DataFrame:
    """Whole texts are told apart by digests; only the five that are shown are read."""
    return full_profile(t.documents.select(*_DOCUMENTS), "documents")


@query("pages_top_texts", " UNION ALL ".join(_top_sql("pages", c) for c in ("url", "html")))
def _pages_top_texts(t: Tables) -> DataFrame:
    """Pages all differ and start alike: the order of equally common long texts is settled piece by piece."""
    return pr.most_common_values(t.pages, ["url", "html"])


@query(
    "profile_footers",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, min({c}) AS low, max({c}) AS high FROM {table}"
        for table, columns in _KINDS.items() for c, kind in columns.items() if kind in ("bigint", "int")
    ),
)
def _profile_footers(t: Tables) -> DataFrame:
    """Rows, nulls and ends of whole numbers, as the files' statistics give them."""
    parts = [pr.stored_basics(t.spark, t.path(table)).withColumn("table_name", F.lit(table)) for table in _KINDS]
    whole = F.col("data_type").isin("bigint", "int")
    ends = [F.col(f"{end}_value").try_cast("bigint").alias(name) for end, name in (("min", "low"), ("max", "high"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(whole).select("table_name", "column_name", "row_count", "null_count", *ends)


_SYNCED = {"customer": (False, True, False), "nation": (False, False, True), "orders": (True, True, False), "supplier": (True, True, True)}


@query(
    "profile_sync",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, {n == "supplier"} AS is_new, {s} AS schema_changed, {d} AS documentation_changed, {code} AS logic_changed, 'successful' AS status,
        count(*) AS row_count, TRUE AS has_page, TIMESTAMP '2024-04-01 00:00:00' AS last_profiled_at FROM {n}"""
        for n, (s, d, code) in _SYNCED.items()
    )
    + """ UNION ALL SELECT 'part', FALSE, FALSE, FALSE, FALSE, NULL, count(*), TRUE, TIMESTAMP '2024-03-01 00:00:00' FROM part""",
)
def _profile_sync(t: Tables) -> DataFrame:
    """Two runs: a column, a comment, a code text and a table are new in the second, which reads and rewrites only these four tables."""
    store, out = scratch_path(t.spark, "store"), scratch_path(t.spark, "profiles")
    logic = t.region.limit(1).select(F.lit("nation").alias("table_name"), F.lit("SELECT 1").alias("text"))
    before = {"orders": lambda: t.orders.drop("o_orderpriority"), "customer": lambda: t.customer, "nation": lambda: t.nation, "part": lambda: t.part}
    after = {**before, "orders": lambda: t.orders, "customer": lambda: catalog.describe(t.customer, {"c_name": "a name"}), "supplier": lambda: t.supplier}
    sync_profiles(t.spark, before, store, out, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    changes = sync_profiles(t.spark, after, store, out, F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"), logic)
    rows = t.spark.read.parquet(f"{out}/profiles").groupBy(F.col("table").alias("table_name")).agg(F.max("row_count").alias("row_count"))
    pages = t.spark.read.text(f"{out}/pages", wholetext=True).select("table_name", F.col("value").startswith("# public.").alias("has_page"))
    stored = fp.stored_fingerprints(t.spark, store).select("table_name", "last_profiled_at")
    flags = changes.select("table_name", "is_new", "schema_changed", "documentation_changed", "logic_changed", "status")
    return flags.join(rows, "table_name").join(pages, "table_name").join(stored, "table_name")
