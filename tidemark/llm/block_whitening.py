"""Whitening of embeddings with distributed block matrices: scatter, eigenvectors and projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, narrow

#: Entries become whole numbers of this part of one.
SCALE = 256
#: Entries beyond this have no exact whole number as double; their rows are left out like those with infinite ones.
LARGEST = 2.0**53 / SCALE
#: Columns of a block at most, and numbers of a block: 2 MB.
BLOCK_COLUMNS, BLOCK_NUMBERS = 1024, 1 << 18
#: Row blocks whose products one task adds up.
BLOCKS_AT_ONCE = 16
#: Directions whose variance is below this part of the largest hold rounding only and are no components.
FLAT = 1e-12

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row within its partition there


def whole_numbers(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows with ``x``, the vector's entries in whole steps; those without a full vector of usable entries are left out."""
    entries = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.forall(entries, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False))), F.lit(False)) & (F.size(entries) > 0)
    return rows.where(usable).withColumn("x", F.transform(entries, lambda c: F.floor(c * SCALE)))


def indexed(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows, written, with ``index`` from 0 without gaps: rows are numbered per file part, and parts by what precedes them."""
    table = scratch.table(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, local = F.shiftright("_at", _LOCAL_BITS).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # One row per task that wrote.
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = table.groupBy(part).agg(F.count("*").alias("_rows")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return table.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn("index", F.col("_before") + local).drop("_part", "_before", "_at")


def block_matrix(rows: DataFrame, vector: Column, n: int, width: int, columns: int) -> BlockMatrix:
    """Indexed rows as a matrix of blocks; all of it stays in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_NUMBERS // columns), columns)


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b; the inner dimension is added up in ``splits`` tasks per block of the result, then these are."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def inner(a: BlockMatrix) -> np.ndarray:
    """Transposed a times a: as many numbers as the square of its width, here on the driver."""
    return product(a.transpose(), a, -(-a.numRowBlocks // BLOCKS_AT_ONCE)).toLocalMatrix().toArray()


@dataclass(frozen=True)
class Whitening:
    """Vectors fitted, their sums, variances along the components, all variance, the projection and its measured error."""

    n: int
    sums: list[int]
    variances: np.ndarray
    trace: float
    projection: np.ndarray
    identity_error: float


def _centred(sums: list[int], n: int) -> Column:
    mean = F.array(*(F.lit(s / n) for s in sums))
    return F.zip_with(F.col("x").cast("array<double>"), mean, lambda c, m: c - m)


def fit(rows: DataFrame, scratch: Scratch, components: int = 4) -> Whitening | None:
    """The whitening of the distinct vectors ``x``; None without a direction that varies.

    Sums are exact. Only sums, the scatter matrix and the covariance of what is projected reach the
    driver: their sizes depend on the width of the vectors alone.
    """
    spark = rows.sparkSession
    kept = indexed(rows.select("x").distinct(), scratch, "fit")
    n = kept.count()
    if not n:
        return None
    totals = kept.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in totals.orderBy("d").collect()]
    width = len(sums)
    columns = min(width, BLOCK_COLUMNS)
    centred = block_matrix(kept, _centred(sums, n), n, width, columns)
    variance = inner(centred) / n
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    falling = np.argsort(-values, kind="stable")[:components]
    falling = falling[values[falling] > FLAT * max(values.max(), 0)]
    if not len(falling):
        return None
    projection = vectors[:, falling] / np.sqrt(values[falling])
    found = Whitening(n, sums, values[falling], float(np.trace(variance)), projection, 0.0)
    shown = inner(product(centred, small_matrix(spark, projection, columns))) / n
    return Whitening(n, sums, found.variances, found.trace, projection, float(np.abs(shown - np.eye(len(falling))).max()))


def small_matrix(spark, values: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A matrix of the driver, as wide as it is and as many rows as vectors have entries, in blocks."""
    table = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(values)], "index bigint, w array<double>")
    vectors = MLUtils.convertVectorColumnsFromML(table.select("index", array_to_vector("w").alias("v")), "v")
    return IndexedRowMatrix(vectors, *values.shape).toBlockMatrix(rows_per_block, values.shape[1])


def project(rows: DataFrame, whitening: Whitening) -> DataFrame:
    """(index, whitened): indexed rows with ``x``, centred and projected as a matrix of blocks."""
    w, columns = whitening, min(len(whitening.sums), BLOCK_COLUMNS)
    matrix = block_matrix(rows, _centred(w.sums, w.n), rows.count(), len(w.sums), columns)
    projected = product(matrix, small_matrix(rows.sparkSession, w.projection, columns)).toIndexedRowMatrix()
    made = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    return made.select(F.col("index"), vector_to_array("vector").alias("whitened"))


def deviation(sums: list[int], n: int) -> Column:
    """Squared distance of n times x from the sums, exact; null beyond 64 bits."""
    if any(abs(s) >= 1 << 63 for s in sums):
        return F.lit(None).cast("bigint")
    total = F.array(*(F.lit(s).cast("bigint") for s in sums))
    apart = F.zip_with("x", total, lambda c, s: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), c), s))
    return F.aggregate(apart, F.lit(0).cast("bigint"), lambda t, a: F.try_add(t, F.try_multiply(a, a)))


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """One row per usable vector and component: (key, component, n, deviation, whitened, explained, identity_error).

    Fitted on distinct vectors, so copies have no weight; every usable row is projected, repeated rows and null
    keys too. Null vectors, those with null, non-finite or huge entries, and those without entries are left out; so are vectors
    of another length than the most common one (the longer of two). Directions without variance are no
    components: without any, and on an empty table, there are no rows. Other columns are left out.
    """
    scratch = Scratch(df.sparkSession, "whiten")
    usable = whole_numbers(narrow(df, key=key, v=vector)).select("key", "x")
    lengths = usable.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    rows = indexed(usable.where(F.size("x") == (lengths["width"] if lengths else 0)), scratch, "rows")
    w = fit(rows, scratch, components) if lengths else None
    kind = dict(df.dtypes)[key]
    if w is None:
        columns = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], columns)
    explained = F.array(*(F.lit(float(e / w.trace)) for e in w.variances))
    joined = rows.select("index", "key", deviation(w.sums, w.n).alias("deviation")).join(project(rows, w), "index")
    entries = F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("_k", "_e")
    return joined.select("key", "deviation", entries).select(
        F.col("key").alias(key), (F.col("_k") + 1).cast("int").alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation",
        F.col("_e.whitened").alias("whitened"), F.col("_e.explained").alias("explained"), F.lit(w.identity_error).alias("identity_error"),
    )
