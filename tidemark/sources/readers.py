"""Table, landing, JDBC and text-corpus scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import ROW_RANK, top_rows

# A landed record is one JSON payload and six extraction columns.
EXTRACTION_COLUMNS = [
    "_sdc_extracted_at", "_sdc_received_at", "_sdc_batched_at",
    "_sdc_deleted_at", "_sdc_sequence", "_sdc_table_version",
]
ENVELOPE = T.StructType(
    [T.StructField("data", T.StringType())]
    + [T.StructField(name, T.TimestampType()) for name in EXTRACTION_COLUMNS[:4]]
    + [T.StructField(name, T.LongType()) for name in EXTRACTION_COLUMNS[4:]]
)


@dataclass(frozen=True)
class Sources:
    """Declared sources: source name -> folder or catalog schema, and its tables."""

    places: Mapping[str, str]
    tables: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    layout: str = "parquet"  # format of folder sources; "catalog" for named schemas

    def read(self, spark: SparkSession, source: str, table: str) -> DataFrame:
        if source not in self.places:
            raise KeyError(f"source {source} is not declared")
        if self.tables.get(source) and table not in self.tables[source]:
            raise KeyError(f"table {table} is not declared in source {source}")
        if self.layout == "catalog":
            return spark.table(f"{self.places[source]}.{table}")
        return spark.read.format(self.layout).load(f"{self.places[source].rstrip('/')}/{table}")


def read_landing(spark: SparkSession, path: str, layout: str = "json") -> DataFrame:
    """Landed records; the schema is given, so no file is read to infer it."""
    return spark.read.schema(ENVELOPE).format(layout).load(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **properties: str,
) -> DataFrame:
    """A database table, in ``partitions`` range queries over ``split_column``.

    The bounds only place the cuts; rows beyond them are read as well.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **properties)
    if split_column is not None:
        low, high = bounds
        reader = reader.options(
            partitionColumn=split_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return reader.load()


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """(path, text) of every matching file below ``folder``; path is relative to it."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    inside = F.substring_index(F.col("_metadata.file_path"), folder.rstrip("/") + "/", -1)
    return files.select(inside.alias("path"), F.col("value").alias("text"))


def query(spark: SparkSession, text: str, *values: object, **named: object) -> DataFrame:
    """SQL over registered tables, with ``?`` or ``:name`` parameters; lazy."""
    if values and named:
        raise ValueError("use positional or named parameters, not both")
    return spark.sql(text, args=list(values) if values else dict(named) if named else None)


def sample_rows(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """An explicit sample; nothing in this package samples by itself."""
    return df.sample(fraction=fraction, seed=seed)


def draw(key: Sequence[str], seed: int = 0) -> Column:
    """A row's lot: a digest of its key and the seed, the same on every run and in any partitioning."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """An explicit sample of exactly ``n`` rows, or of ``n`` per value of ``by``; all of them where there are fewer.

    The rows of the least lots are taken, so every subset of ``n`` keys is as likely, a larger sample holds
    a smaller one, and each task forwards ``n`` rows (per value) at most. ``key`` should tell rows apart: rows
    that share it are drawn together, by a hash of the row.
    """
    order = [draw(key, seed), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    if not by:
        return df.orderBy(*order).limit(n)
    return top_rows(df, list(by), order, n).drop(ROW_RANK)
