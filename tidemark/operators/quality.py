"""Declarative data checks and their report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import orphan_keys
from tidemark.operators.profile import value_histogram


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str
    severity: str = "error"


@dataclass(frozen=True)
class Unique:
    table: str
    column: str
    severity: str = "error"


@dataclass(frozen=True)
class Relationship:
    table: str
    column: str
    parent: str
    parent_column: str
    severity: str = "warn"


Check = NotNull | Unique | Relationship


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def filled(columns: Sequence[str], not_blank: Sequence[str | Column] = ()) -> Column:
    """Whether all natural keys are present (and, for some, not blank); never NULL."""
    present = [F.col(c).isNotNull() for c in columns]
    told = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != "" for c in not_blank]
    return reduce(Column.__and__, [*present, *told], F.lit(True))


def required_rows(df: DataFrame, columns: Sequence[str], not_blank: Sequence[str] = ()) -> DataFrame:
    """Rows with all natural keys present (and, for some, not blank)."""
    return df.where(filled(columns, not_blank))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once, with their count.

    Texts are counted by digest; only rows of a repeated digest are then grouped by their text, each
    task's copies as one, so that texts that occur once are not shuffled where the digests fit a filter.
    """
    known = df.where(F.col(column).isNotNull()).select(column)
    if isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType)):
        key = short_value(df.schema[column])
        repeated = known.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
        known = known.withColumn("_key", key).join(repeated, "_key", "left_semi").drop("_key")
    counts = known.groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") > 1)


def short_value(field: T.StructField) -> Column:
    """A value that is equal exactly where the column is, and no longer than a digest.

    A text of up to 32 characters is itself, a longer one its SHA-256, which has 64.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.when(F.length(column) > 32, F.sha2(column.cast("binary"), 256)).otherwise(column)
    if isinstance(field.dataType, T.BinaryType):
        return F.sha2(column, 256)
    return column


def _report_row(check: Check, kind: str, failures: Column) -> list[Column]:
    return [
        F.lit(check.table).alias("table_name"),
        F.lit(kind).alias("check_name"),
        F.lit(check.column).alias("column_name"),
        F.lit(check.severity).alias("severity"),
        failures.cast("bigint").alias("failures"),
    ]


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check with its failures and a status: pass, warn or fail.

    All not-null checks of a table share one scan, and so do its unique checks.  Failures are rows for
    not_null and relationships, and repeated values for unique.
    """
    parts: list[DataFrame] = []
    for table in dict.fromkeys(c.table for c in checks if isinstance(c, NotNull)):
        wanted = [c for c in checks if isinstance(c, NotNull) and c.table == table]
        counted = tables[table].agg(
            *[F.count_if(F.col(c.column).isNull()).alias(f"n{i}") for i, c in enumerate(wanted)]
        )
        rows = [F.struct(*_report_row(c, "not_null", F.col(f"n{i}"))) for i, c in enumerate(wanted)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    for table in dict.fromkeys(c.table for c in checks if isinstance(c, Unique)):
        wanted = [c for c in checks if isinstance(c, Unique) and c.table == table]
        schema = tables[table].schema
        df = tables[table].select(*[short_value(f).alias(f.name) for f in schema])
        repeated = value_histogram(df, [c.column for c in wanted]).where(F.col("n") > 1)
        place = {name: i + 1 for i, name in enumerate(df.columns)}
        counted = repeated.agg(
            *[F.count_if(F.col("ordinal") == place[c.column]).alias(f"n{i}") for i, c in enumerate(wanted)]
        )
        rows = [F.struct(*_report_row(c, "unique", F.col(f"n{i}"))) for i, c in enumerate(wanted)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    for check in checks:
        if isinstance(check, Relationship):
            orphans = orphan_keys(tables[check.table], check.column, tables[check.parent], check.parent_column)
            found = orphans.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
            parts.append(found.select(*_report_row(check, "relationships", F.col("n"))))
    if not parts:
        raise ValueError("no checks given")
    report = reduce(DataFrame.unionByName, parts)
    failed = F.when(F.col("severity") == "warn", F.lit("warn")).otherwise(F.lit("fail"))
    return report.withColumn("status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(failed))
