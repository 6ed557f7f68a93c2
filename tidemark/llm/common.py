"""What several operators share: names that cannot clash, scratch tables, connected components."""

from __future__ import annotations

import functools
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import freed_shuffles, scratch_path, storage_path

# White space as the contracts have it: the six ASCII characters that bytes.split() also cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under private names: further columns of the input cannot clash."""
    return df.select(*(F.col(f"`{c}`").alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))


def whole(column: str | Column) -> Column:
    """A text, with null as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Rows of an Arrow batch, where the session has not chosen: 10,000 texts at once would fill a worker's memory.
BATCH_ROWS = 512
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


class Scratch:
    """Written intermediate tables in the folder that all executors share.

    A table cuts lineage like a reliable checkpoint does, so a lost executor costs a
    re-read and no earlier stage. Its own shuffle files go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.last = spark, label, {}
        small_batches(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        self.last[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Write a new version, then drop the one before it."""
        before = self.last.get(name)
        after = self.table(df, name)
        if before:
            self._drop(before)
        return after

    def drop(self, *names: str) -> None:
        """Free tables that nothing reads any more."""
        for name in names:
            path = self.last.pop(name, None)
            if path:
                self._drop(path)

    def _drop(self, path: str) -> None:
        fs, hadoop_path = storage_path(self.spark, path)
        fs.delete(hadoop_path, True)


#: Copies of a row that one task numbers or lists at a time.
COPIES_AT_ONCE = 1 << 16


def numbered_copies(copies: DataFrame, keys: list[str], part: str, name: str) -> DataFrame:
    """Rows of equal ``keys`` numbered from 0, as ``name``; ``part`` is the task that wrote a row to a table.

    A group is numbered part by part, and parts by how many rows of the group precede them: no task gets more of a
    group than one part holds.
    """
    sizes = copies.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("_n")
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), before.alias("_before"))
    same = copies[part] == offsets["_p"]
    for i, k in enumerate(keys):
        same &= copies[k].eqNullSafe(offsets[f"_k{i}"])
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.lit(1))) - 1
    ranked = copies.withColumn("_local", local)
    return ranked.join(offsets, same).withColumn(name, F.col("_before") + F.col("_local")).drop("_local", "_before", "_p", *(f"_k{i}" for i in range(len(keys))))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of links ``(a, b)``: ``(node, root)``, root the smallest node reached.

    Every node keeps a parent, at first its smallest neighbour. A round looks up each
    node's grandparent, offers it to all neighbours and to their parents, and keeps minima;
    trees of any shape, long chains too, flatten in a number of rounds that grows with
    the logarithm of their depth. All state stays in tables; one count reaches the driver.
    Nodes without links are absent, null ends are ignored, an empty table gives an empty one.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = scratch.table(ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    parents = scratch.replace(first.select("node", F.least("node", "m").alias("parent")), "parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = scratch.replace(parents.join(up, "parent").select("node", "parent", "grand"), "grand")
        near = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("m"))
        offers = known.join(near, "node").select(
            F.explode(F.array("node", "parent")).alias("node"), F.least("grand", "m").alias("new")
        )
        moved = offers.groupBy("node").agg(F.min("new").alias("new"))
        after = parents.join(moved, "node").select("node", F.least("parent", "new").alias("parent"), (F.col("new") < F.col("parent")).alias("moved"))
        parents = scratch.replace(after, "parents")
        if parents.where("moved").isEmpty():
            scratch.drop("links", "grand")
            return parents.select("node", F.col("parent").alias("root"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; also lets Python workers on this machine import the package from where the driver has it."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@functools.cache
def tokenizer(path: str):
    """A tokenizers file, loaded once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


#: Rows whose texts are Python strings at once.
SLICE = 256


def computed(df: DataFrame, inputs: list[str], outputs: str, function) -> DataFrame:
    """``df`` without the input columns, with ``outputs`` (a schema) that ``function`` makes of their values.

    The function takes one list per input and returns one per output. Other columns pass as Arrow arrays,
    so ids keep their type whether or not some are null.
    """
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c not in inputs]
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.select(*others).dtypes)

    schema = to_arrow_schema(StructType.fromDDL(outputs))

    def run(batches):
        for batch in batches:
            got: list[list] = [[] for _ in schema]
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                for column, more in zip(got, function(*(part.column(c).to_pylist() for c in inputs))):
                    column.extend(more)
            made = [pa.array(v, f.type) for v, f in zip(got, schema)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, *schema.names])

    return df.mapInArrow(run, f"{kinds}, {outputs}")
