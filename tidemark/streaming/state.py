"""Streams that keep state: the newest row per key, and counts per window of time.

State is kept by Spark's own streaming aggregates, in the JVM and on the executors' disks; only what a
micro-batch changed is emitted and upserted into the target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.incremental import upsert

_ARRIVED, _ROW = "_arrived", "_row"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts here keeps its state on disk, unless the session has chosen a store."""
    chosen = spark.conf.get(_PROVIDER, None)
    if chosen and not chosen.endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(_PROVIDER, _ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, chosen) if chosen else spark.conf.unset(_PROVIDER)


def read_stream(spark: SparkSession, source: str, schema: T.StructType | str, source_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(source_format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)


def newest_changes(rows: DataFrame, key: str | Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """The newest row of every key for which this micro-batch brought one; rows with a NULL in their key are left out.

    Larger values of ``newest_by`` are newer, NULL is oldest, and rows that tie go by a hash of the row, so that
    any order of arrival ends in the same state. A row that arrives late changes nothing and emits nothing.
    The state is one row per key; equal keys of a task are combined before the exchange.
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole = F.struct(*rows.columns, _ARRIVED)
    rank = F.struct(*newest_by, F.xxhash64(*rows.columns))
    # The time of a micro-batch is one value, kept in its log: a replayed batch emits the same rows.
    newest = rows.dropna(subset=keys).withColumn(_ARRIVED, F.current_timestamp()).groupBy(*keys).agg(F.max_by(whole, rank).alias(_ROW))
    return newest.where(F.col(f"{_ROW}.{_ARRIVED}") == F.current_timestamp()).select(*[F.col(f"{_ROW}.`{c}`").alias(c) for c in rows.columns])


def window_counts(rows: DataFrame, ts: str, width: str, lateness: str, keys: Sequence[str] = ()) -> DataFrame:
    """(window_start, keys, n): rows per window of event time, as far as they are known.

    Windows that ended more than ``lateness`` before the newest row seen give up their state; rows later than that are
    not counted. Rows without a time are left out.
    """
    timed = rows.where(F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness)
    counted = timed.groupBy(F.window("_at", width).alias("_window"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("_window.start").alias("window_start"), *keys, "n")


def upsert_changes(changes: DataFrame, target: str, key: str | Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upserts every change into the target until all input is taken, then stops.

    Each change holds the whole row of its key, so a micro-batch that is replayed changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert(target, batch, key)

    with _state_on_disk(changes.sparkSession):
        writer = changes.writeStream.outputMode("update").foreachBatch(write)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
