"""What tables there are, their columns, rows and bytes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas that belong to the system.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
DEFAULT_SCHEMA = "public"

INVENTORY = "table_name string, ordinal int, column_name string, data_type string, nullable boolean, description string"


def list_schemas(spark: SparkSession) -> DataFrame:
    found = [(db.name,) for db in spark.catalog.listDatabases()]
    schemas = spark.createDataFrame(found, "schema_name string")
    return schemas.where(~F.col("schema_name").isin(*SYSTEM_SCHEMAS)).orderBy("schema_name")


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """(schema_name, table_name) of stored tables; views are left out."""
    wanted = [schema] if schema else [row.schema_name for row in list_schemas(spark).collect()]
    found = [
        (name, table.name)
        for name in wanted
        for table in spark.catalog.listTables(name)
        if table.tableType not in ("VIEW", "TEMPORARY")
    ]
    return spark.createDataFrame(found, "schema_name string, table_name string").orderBy("schema_name", "table_name")


def column_inventory(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, in table and column order; schema metadata only."""
    rows = [
        (name, i + 1, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, INVENTORY).orderBy("table_name", "ordinal")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table; no column is read."""
    counted = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Bytes and files per table folder: one row per file, no file is opened."""

    def size(name: str, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        return files.agg(
            F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"), F.count("*").alias("file_count")
        ).select(F.lit(name).alias("table_name"), "size_bytes", "file_count")

    return reduce(DataFrame.unionByName, [size(n, p) for n, p in paths.items()])


def describe(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach column comments; they are kept when the table is written."""
    for name, text in comments.items():
        metadata = {**df.schema[name].metadata, "comment": text}
        df = df.withMetadata(name, metadata)
    return df
