"""Streaming form of the incremental load."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedupe import latest_rows
from tidemark.operators.incremental import upsert


def stream_upsert(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    target: str,
    key: str | Sequence[str],
    order: Sequence[Column],
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    source_format: str = "parquet",
    files_per_batch: int | None = None,
    newer_by: str | None = None,
) -> StreamingQuery:
    """Load all files that are new in ``source``, then stop.

    The stream's checkpoint is the high-water mark.  A micro-batch that is
    replayed after a failure upserts the same rows again, which changes nothing.
    ``prepare`` runs on each micro-batch before the newest row per key is taken.
    """
    keys = [key] if isinstance(key, str) else list(key)
    reader = spark.readStream.format(source_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def load(rows: DataFrame, _: int) -> None:
        rows = prepare(rows) if prepare else rows
        upsert(target, latest_rows(rows.dropna(subset=keys), keys, order), keys, newer_by)

    return (
        reader.load(source)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
