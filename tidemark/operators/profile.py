"""Table and column profiles.

Two scans per table, whatever its number of columns: one typed aggregate for row
counts, null counts, minima and maxima, and one long-form histogram for distinct
counts and the most common values. A long text is in the histogram by its digest and its
first characters; only texts that are shown are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from time import perf_counter

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import ROW_RANK, top_rows

# Fixed value: how many of the most common values a profile shows.
SAMPLE_VALUES = 5
# Characters of a text that the histogram holds; a longer one is told apart by its SHA-256.
SHORT_TEXT = 32
# Texts that are read at a time to settle which of equally common ones come first, and by how much more
# of them is compared when they share what was.
SETTLED_AT_ONCE = 64
NEXT_CHARACTERS, MORE = 256, 8

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

COLUMN_PROFILE = (
    "table_name string, ordinal int, column_name string, data_type string, nullable boolean,"
    " row_count bigint, distinct_count bigint, null_percentage double, completeness double,"
    " min_value string, max_value string, sample_values array<string>"
)


def has_range(field: T.StructField) -> bool:
    """Only numbers and times have a meaningful minimum and maximum."""
    return isinstance(field.dataType, (T.NumericType, *TEMPORAL))


def first_temporal(schema: T.StructType) -> str | None:
    return next((f.name for f in schema if isinstance(f.dataType, TEMPORAL)), None)


# A value is held in the slot of its type, so that counting values needs no texts.
SLOTS = {"whole": "bigint", "real": "double", "moment": "timestamp_ntz", "text": "string"}


def value_slot(field: T.StructField, column: Column | None = None) -> tuple[str, Column]:
    """Slot of a column, or of another expression of its type, and its value there; equal exactly when the values are equal.

    Grouping treats -0.0 and 0.0 as one number already.
    """
    kind = field.dataType
    column = F.col(f"`{field.name}`") if column is None else column
    if isinstance(kind, T.IntegralType):
        return "whole", column.cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "whole", F.unix_micros(column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "real", column.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return "moment", column.cast("timestamp_ntz")
    if isinstance(kind, T.BinaryType):
        return "text", F.hex(column)
    if isinstance(kind, T.MapType):
        return "text", F.to_json(F.sort_array(F.map_entries(column)))
    if isinstance(kind, NESTED):
        return "text", F.to_json(column)
    return "text", column.cast("string")


def slot_value(field: T.StructField, value: Column | None = None) -> Column:
    """A value in its column's type, from its slot; maps and other nested values stay JSON texts, bytes stay hex."""
    slot, _ = value_slot(field)
    value = F.col(slot) if value is None else value
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(value)
    return value if isinstance(field.dataType, (T.BinaryType, *NESTED)) else value.cast(field.dataType)


def shown_value(field: T.StructField) -> Column:
    """The text of a value, from its slot."""
    return slot_value(field).cast("string")


def column_basics(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, minimum and maximum as text; one scan, no shuffle.

    The aggregate is one row; it is then turned into one row per column.
    """
    fields = df.schema.fields
    aggregates = [F.count("*").alias("rows")]
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        aggregates.append(F.count(column).alias(f"known{i}"))
        if has_range(field):
            aggregates += [F.min(column).alias(f"min{i}"), F.max(column).alias(f"max{i}")]
    entries = []
    for i, field in enumerate(fields):
        low, high = (F.col(f"min{i}"), F.col(f"max{i}")) if has_range(field) else (F.lit(None), F.lit(None))
        entries.append(
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"known{i}")).alias("null_count"),
                low.cast("string").alias("min_value"),
                high.cast("string").alias("max_value"),
            )
        )
    basics = df.agg(*aggregates).select(F.inline(F.array(*entries)))
    share = F.lit(100.0).cast("double") * F.col("null_count") / F.col("row_count")
    return basics.withColumn("null_percentage", F.when(F.col("row_count") > 0, share).otherwise(F.lit(0.0)))


# Types whose ends a file's statistics hold exactly.
IN_STATISTICS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_PUSHED = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def stored_basics(spark: SparkSession, path: str) -> DataFrame:
    """As ``column_basics``, of a parquet table: rows, nulls and ends come from the files' statistics.

    No row is read for whole numbers and days. All other columns are scanned, at once: the statistics of texts may be
    cut, those of floats leave out NaN, and Spark does not ask for those of instants. Runs its jobs at once.
    """
    df = spark.read.parquet(path)
    held = [f for f in df.schema if isinstance(f.dataType, IN_STATISTICS)]
    counted = _from_statistics(spark, path, held)
    if counted is None:  # a file lacks a column's ends: all of its values there are NULL, or its writer left them out
        alone = {f.name: _from_statistics(spark, path, [f]) for f in held}
        held = [f for f in held if alone[f.name]]
        counted = {"rows": df.count(), **{k: v for f in held for k, v in alone[f.name].items()}}
    rows, found = counted["rows"], {}
    for f in held:
        i = df.columns.index(f.name)
        found[f.name] = (rows - counted[f"known{i}"], *(None if counted[f"{end}{i}"] is None else str(counted[f"{end}{i}"]) for end in ("min", "max")))
    rest = [f for f in df.schema if f not in held]
    if rest:
        for r in column_basics(df.select(*[f"`{f.name}`" for f in rest])).collect():
            found[r["column_name"]] = (r["null_count"], r["min_value"], r["max_value"])
    listed = [(i + 1, f.name, f.dataType.simpleString(), f.nullable, rows, *found[f.name], 100.0 * found[f.name][0] / rows if rows else 0.0) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(
        listed,
        "ordinal int, column_name string, data_type string, nullable boolean, row_count bigint, null_count bigint, min_value string, max_value string, null_percentage double",
    )


def _from_statistics(spark: SparkSession, path: str, fields: Iterable[T.StructField]) -> dict | None:
    """Counts and ends out of the files' statistics; None where a file lacks some, or cannot be read: a scan then says why."""
    before = {k: spark.conf.get(k, None) for k in _PUSHED}
    for k, v in _PUSHED.items():
        spark.conf.set(k, v)
    try:
        return footer_aggregate(spark.read.parquet(path), fields).first().asDict()
    except (Py4JJavaError, PySparkException):
        return None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_aggregate(df: DataFrame, fields: Iterable[T.StructField]) -> DataFrame:
    """One row of counts and ends, each of a plain column, so that a scan can answer them from statistics."""
    aggregates = [F.count("*").alias("rows")]
    for f in fields:
        i, column = df.columns.index(f.name), F.col(f"`{f.name}`")
        aggregates += [F.count(column).alias(f"known{i}"), F.min(column).alias(f"min{i}"), F.max(column).alias(f"max{i}")]
    return df.agg(*aggregates)


def _chosen(df: DataFrame, columns: Iterable[str] | None) -> list[tuple[int, T.StructField]]:
    wanted = set(df.columns if columns is None else columns)
    return [(i + 1, f) for i, f in enumerate(df.schema) if f.name in wanted]


def value_histogram(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(ordinal, slots, digest, n) for every distinct non-null value of every column.

    NULLs are dropped before the exchange and equal values are counted on the map
    side, so neither a sparse column nor a dominant value makes a hot task.  The text slot
    holds a long text's start only, and ``digest`` its SHA-256: no exchange holds whole texts.
    """
    entries = []
    for ordinal, field in _chosen(df, columns):
        filled, value = value_slot(field)
        is_long = F.char_length(value) > SHORT_TEXT if may_be_long(field) else F.lit(False)
        held = F.when(is_long, F.substring(value, 1, SHORT_TEXT)).otherwise(value) if may_be_long(field) else value
        slots = [(held if s == filled else F.lit(None).cast(kind)).alias(s) for s, kind in SLOTS.items()]
        digest = F.when(is_long, F.unhex(F.sha2(value.cast("binary"), 256))) if may_be_long(field) else F.lit(None).cast("binary")
        entries.append(F.struct(F.lit(ordinal).alias("ordinal"), *slots, digest.alias("digest")))
    values = df.select(F.inline(F.array(*entries))).where(" OR ".join(f"{s} IS NOT NULL" for s in SLOTS))
    return values.groupBy("ordinal", *SLOTS, "digest").agg(F.count("*").alias("n"))


def may_be_long(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BinaryType, *NESTED))


def _by_ordinal(df: DataFrame, columns: Iterable[str] | None, expression: Callable[[T.StructField], Column]) -> Column:
    result = F
    for ordinal, field in _chosen(df, columns):
        result = result.when(F.col("ordinal") == ordinal, expression(field))
    return result


def distinct_values(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per column.

    Every ``n`` is positive; asking for it keeps the histogram the same as the one
    the most common values come from, so that both read one exchange.
    """
    counts = value_histogram(df, columns).groupBy("ordinal").agg(F.count_if(F.col("n") > 0).alias("distinct_count"))
    return counts.select(_by_ordinal(df, columns, lambda f: F.lit(f.name)).alias("column_name"), "distinct_count")


def approximate_distinct_values(df: DataFrame) -> DataFrame:
    """Sketch-based counts: one scan, no shuffle of values.  An explicit choice only."""
    counts = df.agg(*[F.approx_count_distinct(value_slot(f)[1]).alias(f"d{i}") for i, f in enumerate(df.schema)])
    entries = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"d{i}").alias("distinct_count"))
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*entries)))


def _ranked(df: DataFrame, columns: Iterable[str] | None, k: int) -> DataFrame:
    """The k most common values per column, ties by value; equally common long texts that start alike are in no order yet."""
    order = [F.desc("n"), *[F.asc(slot) for slot in SLOTS], F.asc("digest")]
    return top_rows(value_histogram(df, columns), ["ordinal"], order, k)


def _smallest_texts(df: DataFrame, field: T.StructField, n: int, start: str, wanted: int) -> list[str]:
    """The first ``wanted`` texts in order, among the long ones that begin with ``start`` and occur ``n`` times.

    Digests are counted with a next piece of their text; whole texts are read for a bounded number of digests. Where
    more than that share the piece, the next one is compared, several times as long.
    """
    rows = df.select(value_slot(field)[1].alias("t")).where((F.char_length("t") > SHORT_TEXT) & F.startswith("t", F.lit(start)))
    digest, at_once, length, out = F.sha2(F.col("t").cast("binary"), 256), max(SETTLED_AT_ONCE, 2 * wanted), NEXT_CHARACTERS, []

    def read(digests: list[str]) -> list[str]:
        texts = rows.where(digest.isin(digests)).groupBy(digest.alias("digest")).agg(F.first("t").alias("t")) if digests else None
        return sorted((r["t"] for r in texts.collect()), key=str.encode) if digests else []

    while len(out) < wanted:
        pieces = rows.groupBy(digest.alias("digest"), F.substring("t", len(start) + 1, length).alias("piece")).agg(F.count("*").alias("n"))
        found = [(r["piece"].encode(), r["digest"]) for r in pieces.where(F.col("n") == n).orderBy("piece", "digest").limit(at_once).collect()]
        edge = found[wanted - len(out) - 1][0]
        if len(found) < at_once or found[-1][0] > edge:
            return (out + read([d for piece, d in found if piece <= edge]))[:wanted]
        out += read([d for piece, d in found if piece < edge])
        start, length = start + edge.decode(), length * MORE
        rows = rows.where(F.startswith("t", F.lit(start)))
    return out


def _settled(df: DataFrame, columns: Iterable[str] | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct counts and most common values as small tables: one job over the histogram, and few more for long texts shown."""
    fields = dict(_chosen(df, columns))
    shown = _by_ordinal(df, columns, shown_value)
    # Every n is positive; asking for it keeps the histogram the same, so that both read one exchange.
    counts = value_histogram(df, columns).groupBy("ordinal").agg(F.count_if(F.col("n") > 0).alias("n")).withColumn(ROW_RANK, F.lit(0))
    parts = _ranked(df, columns, k).select("ordinal", "n", ROW_RANK, shown.alias("value"), F.col("text").alias("start"), F.col("digest").isNotNull().alias("is_long"))
    distinct, top, unsettled = [], [], {}
    for r in sorted(counts.unionByName(parts, allowMissingColumns=True).collect(), key=lambda r: (r["ordinal"], r[ROW_RANK])):
        name = fields[r["ordinal"]].name
        if r[ROW_RANK] == 0:
            distinct.append((name, r["n"]))
        else:
            top.append([name, r[ROW_RANK], r["value"], r["n"]])
            if r["is_long"]:
                unsettled.setdefault((r["ordinal"], r["n"], r["start"]), []).append(top[-1])
    for (ordinal, n, start), entries in unsettled.items():
        for entry, text in zip(entries, _smallest_texts(df, fields[ordinal], n, start, len(entries)), strict=True):
            entry[2] = text
    create = df.sparkSession.createDataFrame
    return create(distinct, "column_name string, distinct_count bigint"), create(top, "column_name string, value_rank int, value string, n bigint")


def most_common_values(
    df: DataFrame, columns: Iterable[str] | None = None, k: int = SAMPLE_VALUES
) -> DataFrame:
    """(column_name, value_rank, value, n): the k most common values per column.

    Ties go to the smaller value.  Only k rows per column and task are shuffled,
    and only what is left gets a text.  Columns that may hold long texts run jobs at once.
    """
    if any(may_be_long(f) for _, f in _chosen(df, columns)):
        return _settled(df, columns, k)[1]
    return _ranked(df, columns, k).select(
        _by_ordinal(df, columns, lambda f: F.lit(f.name)).alias("column_name"),
        F.col(ROW_RANK).alias("value_rank"),
        _by_ordinal(df, columns, shown_value).alias("value"),
        "n",
    )


def column_profile(
    df: DataFrame, name: str, k: int = SAMPLE_VALUES, approximate: bool = False
) -> DataFrame:
    """One row per column, as ``COLUMN_PROFILE`` describes."""
    basics = column_basics(df)
    if any(map(may_be_long, df.schema)):
        distinct, top = _settled(df, None, k)
    else:
        distinct, top = distinct_values(df), most_common_values(df, k=k)
    distinct = approximate_distinct_values(df) if approximate else distinct
    samples = top.groupBy("column_name").agg(
        # at most k entries per column
        F.transform(F.sort_array(F.collect_list(F.struct("value_rank", "value"))), lambda s: s["value"]).alias(
            "sample_values"
        )
    )
    joined = basics.join(distinct, "column_name", "left").join(samples, "column_name", "left")
    return joined.select(
        F.lit(name).alias("table_name"),
        "ordinal",
        "column_name",
        "data_type",
        "nullable",
        "row_count",
        F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
        "null_percentage",
        (F.lit(100.0).cast("double") - F.col("null_percentage")).alias("completeness"),
        "min_value",
        "max_value",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def time_range(df: DataFrame, name: str) -> DataFrame:
    """Rows and the time coverage of the first temporal column in column order."""
    column = first_temporal(df.schema)
    low, high = (F.min(f"`{column}`"), F.max(f"`{column}`")) if column else (F.lit(None), F.lit(None))
    return df.agg(
        F.count("*").alias("row_count"), low.cast("string").alias("min_date"), high.cast("string").alias("max_date")
    ).select(F.lit(name).alias("table_name"), F.lit(column).cast("string").alias("time_column"), "row_count", "min_date", "max_date")


def table_profile(columns: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row per profiled table, from its column profiles and optional byte sizes."""
    temporal = F.col("data_type").isin("date", "timestamp", "timestamp_ntz")
    first = F.min(F.when(temporal, F.struct("ordinal", "column_name", "min_value", "max_value")))
    profiled = columns.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count("*").alias("column_count"), first.alias("_first")
    )
    result = profiled.select(
        "table_name",
        "row_count",
        "column_count",
        F.col("_first.column_name").alias("time_column"),
        F.col("_first.min_value").alias("min_date"),
        F.col("_first.max_value").alias("max_date"),
    )
    return result if sizes is None else result.join(sizes, "table_name", "left")


def profile_tables(
    spark: SparkSession,
    tables: Mapping[str, Callable[[], DataFrame]],
    out: str,
    k: int = SAMPLE_VALUES,
    at_once: int = 4,
) -> DataFrame:
    """Profile many tables into ``out`` and return the run log.

    Each table is a job of its own, a few at a time; one that fails is logged and
    the others go on.  ``tables`` maps a name to a function that opens the table.
    """

    def run(name: str) -> tuple:
        started = perf_counter()
        try:
            column_profile(tables[name](), name, k).write.mode("overwrite").parquet(f"{out}/table={name}")
            return name, "successful", perf_counter() - started, None
        except Exception as problem:  # the log keeps it; the other tables go on
            return name, "failed", perf_counter() - started, f"{type(problem).__name__}: {problem}"

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        log = list(pool.map(run, sorted(tables)))
    return spark.createDataFrame(log, "table_name string, status string, duration double, error string")
