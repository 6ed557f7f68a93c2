"""Grouped measures.

All of them are plain partial/final aggregates: rows are combined on the map side
and only one row per group and task is shuffled, whatever the group sizes are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import days_before, utc_wall_time, whole_days
from tidemark.functions.measures import count_where
from tidemark.operators.dedupe import latest_rows, top_rows
from tidemark.operators.profile import SLOTS, value_slot

# Bytes of a SHA-256, recency windows in days, weekend days (1 = Sunday) and office hours.
DIGEST_BYTES = 32
RECENT_ROW_DAYS = (30, 90, 180, 365)
RECENT_DAY_DAYS = (30, 90, 365)
WEEKEND = (1, 7)
WEEKDAYS = (2, 6)
OFFICE_HOURS = (9, 17)


def labelled_count(df: DataFrame, column: str, missing: str, count_name: str) -> DataFrame:
    """Rows per value; NULL is shown as ``missing`` but grouped by the raw value.

    A real value that equals the label therefore keeps a row of its own.
    """
    counted = df.groupBy(column).agg(F.count("*").alias(count_name))
    return counted.select(F.coalesce(F.col(column), F.lit(missing)).alias(column), count_name)


def group_count(df: DataFrame, keys: Sequence[str], count_name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(count_name))


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[count_where(c).alias(n) for n, c in conditions.items()])


def distinct_counts(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Exact distinct non-null values per key; a pair counts the values of rows where its condition holds.

    Measures of one value share a row per key and value. Whole numbers, days and instants go 64 to a row, as bits of a word, one
    word per measure: words are united on the map side and their bits counted, so that neither rows are
    repeated per measure nor near values cost a row each. Other values are a row each, long texts by digest.
    """
    measures = {n: v if isinstance(v, tuple) else (v, F.lit(True)) for n, v in values.items()}
    texts = {n: str(v) for n, (v, _) in measures.items()}
    groups = list(dict.fromkeys(texts.values()))
    width = max(sum(t == g for t in texts.values()) for g in groups)
    value_of = {t: measures[n][0] for n, t in texts.items()}
    slotted = {g: _distinct_slot(df.select(value_of[g].alias("v")).schema["v"], value_of[g]) for g in groups}
    slots = {s: kind for s, kind in {"word": "bigint", "bytes": "binary", **SLOTS}.items() if s in {slot for slot, _, _ in slotted.values()}}
    entries, place = [], {}
    for number, group in enumerate(groups):
        members = [n for n, t in texts.items() if t == group]
        value, (slot, held, bit) = value_of[group], slotted[group]
        words = [F.when(value.isNotNull() & measures[n][1], bit) for n in members] + [F.lit(None).cast("bigint")] * (width - len(members))
        place.update({n: (number, f"_w{i}") for i, n in enumerate(members)})
        cells = [(held if s == slot else F.lit(None).cast(kind)).alias(f"_{s}") for s, kind in slots.items()]
        entries.append(F.struct(F.lit(number).alias("_group"), *cells, *(w.alias(f"_w{i}") for i, w in enumerate(words))))
    rows = df.select(*keys, F.inline(F.array(*entries)))
    # The first group keeps rows without a value, so that every key has a row.
    filled = rows.where((F.col("_group") == 0) | F.coalesce(*[F.col(f"_w{i}") for i in range(width)]).isNotNull())
    united = filled.groupBy(*keys, "_group", *(f"_{s}" for s in slots)).agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(width)])
    return united.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("_group") == g, F.bit_count(w))), F.lit(0)).cast("bigint").alias(n) for n, (g, w) in ((n, place[n]) for n in measures)]
    )


def _distinct_slot(field: T.StructField, value: Column) -> tuple[str, Column, Column]:
    """Slot of a value, what is held there, and its bit in a word."""
    if isinstance(field.dataType, (T.IntegralType, T.DateType, T.TimestampType)):
        days = F.unix_date(value) if isinstance(field.dataType, T.DateType) else value
        whole = (F.unix_micros(value) if isinstance(field.dataType, T.TimestampType) else days).cast("bigint")
        return "word", F.shiftright(whole, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), whole.bitwiseAND(F.lit(63)).cast("int"))
    slot, held = value_slot(T.StructField("v", field.dataType), value)
    if slot == "text":  # as long as a digest or longer: by it, so that no text held whole is as long as one
        bits = held.cast("binary")
        return "bytes", F.when(F.octet_length(held) >= DIGEST_BYTES, F.unhex(F.sha2(bits, 256))).otherwise(bits), F.lit(1).cast("bigint")
    return slot, held, F.lit(1).cast("bigint")


def any_true(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """True when one row of the group has the flag; NULL counts as false."""
    return df.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def recency_counts(df: DataFrame, key: str, ts: str, as_of: Column, noun: str) -> DataFrame:
    """Rows and distinct days in the windows that end at ``as_of``."""
    wall = utc_wall_time(df, ts)
    day = wall.cast("date")
    rows = {f"{noun}_last_{n}_days": count_where(wall >= days_before(as_of, n)) for n in RECENT_ROW_DAYS}
    # Days per key first: the distinct counts then need no Expand over the raw rows.
    per_day = df.groupBy(key, day.alias("_day")).agg(
        *[c.alias(n) for n, c in rows.items()],
        *[count_where(wall >= days_before(as_of, n)).alias(f"_in_{n}") for n in RECENT_DAY_DAYS],
        F.max(wall).alias("_last"),
    )
    return per_day.groupBy(key).agg(
        *[F.sum(n).alias(n) for n in rows],
        *[F.count_if(F.col(f"_in_{n}") > 0).alias(f"active_days_last_{n}") for n in RECENT_DAY_DAYS],
        F.max("_last").alias("most_recent_at"),
    )


def time_span(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time and the whole days between them."""
    wall = utc_wall_time(df, ts)
    spans = df.groupBy(key).agg(F.min(wall).alias("first_at"), F.max(wall).alias("last_at"))
    return spans.withColumn("days_active_span", whole_days(F.col("first_at"), F.col("last_at")))


def group_mode(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return latest_rows(counts, [key], [F.desc("_n"), F.asc(value)]).select(
        key, F.col(value).alias(name), F.col("_n").alias(f"{name}_count")
    )


def day_intensity(df: DataFrame, key: str, ts: str, noun: str) -> DataFrame:
    """Average and maximum of the rows per day."""
    day = utc_wall_time(df, ts).cast("date").alias("_day")
    per_day = df.groupBy(key, day).agg(F.count("*").alias("_n"))
    return per_day.groupBy(key).agg(
        F.count("_day").alias("active_days"),
        F.avg("_n").alias(f"avg_{noun}_per_active_day"),
        F.max("_n").alias(f"max_{noun}_in_day"),
    )


def in_weekend(day_of_week: Column) -> Column:
    return day_of_week.isin(*WEEKEND)


def on_weekday(day_of_week: Column) -> Column:
    return day_of_week.between(*WEEKDAYS)


def in_office_hours(hour: Column) -> Column:
    return hour.between(*OFFICE_HOURS)


def out_of_office_hours(hour: Column) -> Column:
    return (hour < OFFICE_HOURS[0]) | (hour > OFFICE_HOURS[1])


def time_of_week(df: DataFrame, key: str, ts: str, noun: str) -> DataFrame:
    """Rows by weekend/weekday and by office hours."""
    wall = utc_wall_time(df, ts)
    return conditional_counts(
        df,
        [key],
        {
            f"weekend_{noun}": in_weekend(F.dayofweek(wall)),
            f"weekday_{noun}": on_weekday(F.dayofweek(wall)),
            f"business_hours_{noun}": in_office_hours(F.hour(wall)),
            f"off_hours_{noun}": out_of_office_hours(F.hour(wall)),
        },
    )


def latest_attributes(
    df: DataFrame, key: str, order: Sequence[Column], attributes: Sequence[str]
) -> DataFrame:
    """Attributes of the first row in ``order`` per key."""
    return latest_rows(df, [key], order).select(key, *attributes)


def top_values(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values per key, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    ranked = top_rows(counts, [key], [F.desc("n"), F.asc(value)], k)
    return ranked.withColumnRenamed("_row_rank", "value_rank")
