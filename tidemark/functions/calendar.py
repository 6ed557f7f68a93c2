"""Calendar dimensions and day arithmetic, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_wall_time(df: DataFrame, ts: str) -> Column:
    """UTC wall-clock time of a column, whatever the session time zone is."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        local = F.col(ts).cast("timestamp_ntz")
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return F.col(ts)


def calendar_columns(wall: Column, prefix: str) -> dict[str, Column]:
    """Day, Monday week, month, quarter and year starts, weekday (1 = Sunday), hour."""
    day = wall.cast("date")
    return {
        f"{prefix}_date": day,
        f"{prefix}_week": F.trunc(day, "week"),
        f"{prefix}_month": F.trunc(day, "month"),
        f"{prefix}_quarter": F.trunc(day, "quarter"),
        f"{prefix}_year": F.trunc(day, "year"),
        f"{prefix}_day_of_week": F.dayofweek(day).cast("bigint"),
        f"{prefix}_hour": F.hour(wall).cast("bigint"),
    }


def with_calendar(df: DataFrame, ts: str, prefix: str) -> DataFrame:
    return df.withColumns(calendar_columns(utc_wall_time(df, ts), prefix))


def epoch_seconds(wall: Column) -> Column:
    """Whole seconds since 1970 of a zone-less UTC time, floored."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, wall)
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000000).cast("bigint")), F.lit(1000000).cast("bigint"))


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods between two UTC wall times, truncated toward zero."""
    seconds = epoch_seconds(end) - epoch_seconds(start)
    return F.call_function("div", seconds, F.lit(86400).cast("bigint"))


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def utc_now() -> Column:
    """Wall-clock time in UTC, one value per query."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
