"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only settings that change results or let Spark re-plan at run time.  Memory,
# parallelism and partition counts belong to whoever submits the job.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even if that costs a later operator its layout.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Checkpoints that no table needs any more are removed from the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # The JVM never compiles methods beyond this size; a wide JSON projection is
    # faster as many small methods than as one large interpreted one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the defaults above; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_HUGE, _HUGE_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def compiled_methods(spark: SparkSession) -> None:
    """The limit above for wide projections, where the session has not chosen one."""
    if spark.conf.get(_HUGE, _HUGE_DEFAULT) == _HUGE_DEFAULT:
        spark.conf.set(_HUGE, SESSION_DEFAULTS[_HUGE])


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins; then a checkpoint folder somebody has set on
    the context.  Only a session with neither (a local test) gets a temporary one.
    """
    context = spark.sparkContext
    jvm_context = context._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if jvm_context.getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if jvm_context.getCheckpointDir().isDefined():
        return jvm_context.getCheckpointDir().get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name below the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and read it from there on."""
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    if getattr(_checkpoints, "made", None) is not None:
        _checkpoints.made.append(cut)
    return cut


# Of each thread: what is materialised inside a block that drops it.
_checkpoints = threading.local()


@contextlib.contextmanager
def dropped_checkpoints(spark: SparkSession):
    """What ``cut_lineage`` writes inside is deleted at the end; nothing may read it any more."""
    outer, _checkpoints.made = getattr(_checkpoints, "made", None), []
    try:
        yield
    finally:
        made, _checkpoints.made = _checkpoints.made, outer
        for df in made:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                fs, path = storage_path(spark, file.get())
                fs.delete(path, True)


def storage_path(spark: SparkSession, path: str):
    """Hadoop (file system, path) pair, so the same code works on any store."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


# Shuffle files otherwise stay until the driver collects garbage; a stage whose files are gone runs again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Blocks at work, and what the session had chosen before the first of them.
_freeing = {"lock": threading.Lock(), "blocks": 0, "chosen": None}


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is run inside frees its shuffle files as soon as it ends; the session's own choice holds again after the last such block."""
    with _freeing["lock"]:
        if not _freeing["blocks"]:
            _freeing["chosen"] = spark.conf.get(_CLEANUP, None)
        _freeing["blocks"] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _freeing["lock"]:
            _freeing["blocks"] -= 1
            if not _freeing["blocks"]:
                spark.conf.unset(_CLEANUP) if _freeing["chosen"] is None else spark.conf.set(_CLEANUP, _freeing["chosen"])


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = storage_path(spark, path)
    return bool(fs.exists(hadoop_path))


# Largest text column, in bytes, that a join may broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, column: str, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``df`` with a broadcast hint if its one column is measured to be small, and its rows.

    Meant for frames that are already materialised, so that measuring is cheap.
    Beyond the limit the planner picks a shuffled join.
    """
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()
    return (F.broadcast(df) if size + 16 * rows <= limit else df), rows


def write_marker(spark: SparkSession, path: str, text: str) -> None:
    """A small file that says a folder is complete."""
    fs, marker = storage_path(spark, path)
    stream = fs.create(marker, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def read_marker(spark: SparkSession, path: str) -> str | None:
    fs, marker = storage_path(spark, path)
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
