"""Full-refresh tables, views and rendered profile documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import human_bytes

# Lines of one landed file. A compressed file is read by one task, and a task reads some twenty such files at most,
# as Spark counts 4 MB for opening each.
LANDED_PER_FILE = 20_000


def write_table(df: DataFrame, place: str, layout: str = "parquet", as_table: bool = False) -> None:
    """Replace the table's contents; ``as_table`` registers it under that name."""
    writer = df.write.mode("overwrite").format(layout)
    writer.saveAsTable(place) if as_table else writer.save(place)


def publish_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def write_landing(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one record per row, in compressed files; times keep their microseconds."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    files = {"compression": "gzip", "maxRecordsPerFile": LANDED_PER_FILE}
    df.write.mode(mode).options(timestampFormat=f"{pattern}XXX", timestampNTZFormat=pattern, **files).json(path)


def _bullet(title: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{title}**: "), value.cast("string"))


def _titled(title: str, lines: Column) -> Column:
    """A titled block of lines; nothing at all without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(title), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))


def model_section(models: DataFrame) -> DataFrame:
    """(table_name, _model): metadata and dependencies of models as ``graph.scan_models`` finds them.

    A ``description`` column is shown if there is one.
    """
    described = F.col("description") if "description" in models.columns else F.lit(None).cast("string")
    facts = F.array_compact(
        F.array(
            _bullet("Materialization", F.coalesce(F.col("config")["materialized"], F.lit("view"))),
            _bullet("Tags", F.nullif(F.col("config")["tags"], F.lit(""))),
            _bullet("Description", F.nullif(described, F.lit(""))),
        )
    )
    upstream = F.transform(F.array_distinct("refs"), lambda r: F.concat(F.lit("- `"), r, F.lit("`")))
    sources = F.transform(
        F.array_distinct("sources"), lambda s: F.concat(F.lit("- `"), s["source_name"], F.lit("."), s["table_name"], F.lit("`"))
    )
    # The headings.
    section = F.concat(
        _titled("## dbt Model Metadata\n\n", facts), _titled("**Upstream Dependencies:**\n", upstream), _titled("**Sources:**\n", sources)
    )
    return models.select(F.col("name").alias("table_name"), section.alias("_model"))


def description_section(described: DataFrame) -> DataFrame:
    """(table_name, _described): the described columns of ``(table_name, ordinal, column_name, description, tests)``."""
    tests = F.when(F.size("tests") > 0, F.concat(F.lit("**Tests**: "), F.array_join("tests", ", "), F.lit("\n\n"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("### "), "column_name", F.lit("\n\n"), "description", F.lit("\n\n"), tests)
    told = described.where(F.length("description") > 0).select("table_name", F.struct("ordinal", entry.alias("entry")).alias("_entry"))
    listed = told.groupBy("table_name").agg(F.sort_array(F.collect_list("_entry")).alias("_entries"))
    text = F.concat(F.lit("## Column Descriptions\n\n"), F.array_join(F.transform("_entries", lambda e: e["entry"]), ""))
    return listed.select("table_name", text.alias("_described"))


def render_profiles(
    columns: DataFrame, tables: DataFrame, schema: str = "public", models: DataFrame | None = None, described: DataFrame | None = None
) -> DataFrame:
    """(schema_name, table_name, document): one Markdown page per profiled table.

    ``models`` and ``described`` add the sections of ``model_section`` and
    ``description_section`` to the tables they name.  The lines that are gathered
    are a table's columns, which its schema bounds.
    """
    yes_no = F.when(F.col("nullable"), F.lit("Yes")).otherwise(F.lit("No"))
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            "column_name",
            "data_type",
            yes_no,
            F.format_number("distinct_count", 0),
            F.concat(F.format_number("null_percentage", 1), F.lit("%")),
        ),
        F.lit(" |"),
    )
    listed = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    lines = columns.groupBy("table_name").agg(F.transform(listed, lambda e: e["line"]).alias("_lines"))

    title = F.concat(F.lit(f"{schema}."), F.col("table_name"))
    facts = F.array_compact(
        F.array(
            F.lit(f"- **Database**: {schema}"),
            _bullet("Table", F.col("table_name")),
            _bullet("Row Count", F.format_number("row_count", 0)),
            _bullet("Size", human_bytes(F.col("size_bytes"))),
            _bullet("Time Range", F.concat("min_date", F.lit(" to "), "max_date")),
        )
    )
    page = F.concat(
        F.lit("# "), title, F.lit("\n\n## Table Information\n\n"), F.array_join(facts, "\n"),
        F.lit("\n\n## Schema\n\n| Column | Type | Nullable | Distinct | Null % |\n|---|---|---|---|---|\n"),
        F.array_join("_lines", "\n"), F.lit("\n\n"), F.coalesce("_model", F.lit("")), F.coalesce("_described", F.lit("")),
        F.lit("## Example Query\n\n```sql\nSELECT *\nFROM "), title, F.lit("\nLIMIT 10;\n```\n"),
    )
    if "size_bytes" not in tables.columns:
        tables = tables.withColumn("size_bytes", F.lit(None).cast("bigint"))
    pages = tables.join(lines, "table_name")
    pages = pages.join(model_section(models), "table_name", "left") if models is not None else pages.withColumn("_model", F.lit(""))
    pages = pages.join(description_section(described), "table_name", "left") if described is not None else pages.withColumn("_described", F.lit(""))
    return pages.select(F.lit(schema).alias("schema_name"), "table_name", page.alias("document"))


def write_documents(documents: DataFrame, path: str, keep_others: bool = False) -> None:
    """One folder per schema and table, one text file in each; ``keep_others`` leaves tables that are not named as they are."""
    mode = "dynamic" if keep_others else "static"
    documents.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("schema_name", "table_name").text(path)
