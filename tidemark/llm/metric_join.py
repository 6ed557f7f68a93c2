"""Exact near-duplicate join of embeddings: pivots part the space, the triangle inequality sets what crosses."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, narrow

THRESHOLD = 0.93
#: Vectors a cell aims at, pivots of a label and of all labels at most (further vectors make cells
#: larger, never lose links).
CELL, LABEL_PIVOTS, ALL_PIVOTS = 1024, 1024, 8192
#: Bytes of all pivots, which every task gets.
PIVOT_BYTES = 1 << 26
#: Vectors whose links one task finds at a time, and vectors that it compares them with.
PART, AGAINST = 1024, 16384
#: Rounding that distances to pivots may carry.
SLACK = 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def pivot_counts(sizes: list[int], dimensions: list[int]) -> list[int]:
    """Pivots of each group, by its size; 0 where it is one cell.

    All groups aim at cells of one size: CELL vectors, or as many more as keep all pivots together
    within ALL_PIVOTS and PIVOT_BYTES. So no group takes the pivots of another.
    """
    cell = CELL
    while True:
        counts = [k if (k := min(LABEL_PIVOTS, n // cell)) > 1 else 0 for n in sizes]
        if sum(counts) <= ALL_PIVOTS and sum(8 * k * d for k, d in zip(counts, dimensions)) <= PIVOT_BYTES:
            return counts
        cell += 1 + cell // 8


class Cells:
    """Where vectors live and which cells they visit, per group of one label and dimension."""

    def __init__(self, pivots: dict[tuple, np.ndarray], radius: float):
        self.pivots, self.radius = pivots, radius

    def place(self, group: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each unit vector, and a matrix of the cells it must be compared in.

        Within the radius of a vector y at home with pivot p, a vector x at home with h lies at most
        the radius beyond the plane half way from h to p; unit vectors show that distance by their
        cosines. Its own cell always counts.
        """
        p = self.pivots.get(group)
        if p is None:
            return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
        near = x @ p.T
        home = near.argmax(1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]
        visits = near[np.arange(len(x)), home][:, None] - near <= self.radius * apart + SLACK
        visits[np.arange(len(x)), home] = True
        return home, visits


def link_within(
    x: np.ndarray, ids: np.ndarray, weights: np.ndarray, home: np.ndarray, other: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links of the ``home`` rows to the ``other`` rows, and a component label for all rows, in blocks of rows.

    A row may be both; it then counts its copies. Components join by the links found here: rows of a block
    take the least label among their links, and labels that meet are merged.
    """
    mine, theirs = np.flatnonzero(home), np.flatnonzero(other)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    place = np.full(len(x), -1)
    place[theirs] = np.arange(len(theirs))
    step = max(1, (1 << 22) // max(1, len(theirs)))
    for k in range(0, len(mine), step):
        rows = mine[k : k + step]
        linked = (x[rows] @ x[theirs].T) / (norm[rows][:, None] * norm[theirs]) >= threshold
        both = np.flatnonzero(place[rows] >= 0)
        linked[both, place[rows[both]]] = True  # a vector and its copies, whatever the rounding
        links[rows] = linked @ weights[theirs] - other[rows]
        for row, found in zip(rows, linked):
            met = np.unique(np.append(root[theirs[found]], root[row]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return links, least[root]


def deal(copied: DataFrame, grid: DataFrame) -> DataFrame:
    """Every visit of a vector to a cell, once per (part, block) of the cell that the vector is needed in.

    In its block a vector meets all parts (``other``); in its part, if it is at home, it is compared with all blocks (``home``).
    """
    placed = copied.join(grid, ["label", "d", "cell"]).withColumns(
        {"own": F.pmod(F.xxhash64("class", F.lit(11)), F.col("parts")).cast("int"), "block": F.pmod(F.xxhash64("class", F.lit(13)), F.col("blocks")).cast("int")}
    )
    across = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("p"), F.col("block").alias("b"), (F.col("home") & (p == F.col("own"))).alias("h"), F.lit(True).alias("o")))
    along = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("own").alias("p"), b.alias("b"), F.lit(True).alias("h"), F.lit(False).alias("o")))
    along = F.filter(along, lambda at: F.col("home") & (at["b"] != F.col("block")))
    dealt = placed.withColumn("at", F.explode(F.concat(across, along)))
    return dealt.select("label", "d", "cell", F.col("at.p").alias("part"), F.col("at.b").alias("block"), "class", "weight", "v", F.col("at.h").alias("home"), F.col("at.o").alias("other"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Rows of one label (not null) whose cosine is at least the threshold are linked. Copies of a vector are one class with
    a weight, reduced before the shuffle. Groups of more than two cells' worth get pivots: a hash-ordered sample of
    their vectors, shared by size and bounded by LABEL_PIVOTS, ALL_PIVOTS and PIVOT_BYTES; these are all that is sent to tasks. A vector's links are
    all found in its home cell, to which every vector within reach is copied. A cell's own vectors are dealt in parts and all that
    are there in blocks; each part meets each block in a group of its own, so that no group grows with the data.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even copies; so do
    rows with a null label and vectors of different length. Repeated rows are copies of each other, and a null id is never
    the smallest; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    radius = math.sqrt(2 - 2 * threshold)
    rows = narrow(vectors, id=id_col, label=label_col, v=F.col(f"`{vector_col}`").cast("array<double>"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    some = F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False)))
    classes = scratch.table(
        rows.where("valid").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumns({"class": F.xxhash64("label", "v"), "d": F.size("v")}),
        "classes",
    )
    # Sizes of the groups that need pivots: each stands for more than two cells of vectors. Pivots come two at least, so more groups could get none.
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL).orderBy(F.col("n").desc(), "label", "d").limit(ALL_PIVOTS // 2).collect()
    shared = zip(sizes, pivot_counts([r["n"] for r in sizes], [r["d"] for r in sizes]))
    wanted = [(r["label"], r["d"], k, min(1.0, 4.0 * k / r["n"] + 64.0 / r["n"])) for r, k in shared if k]
    pivots: dict[tuple, np.ndarray] = {}
    if wanted:
        kind = dict(classes.dtypes)["label"]
        asked = spark.createDataFrame(wanted, f"label {kind}, d int, k int, part double")
        # Few candidates by hash first, so that no task orders a whole label.
        chance = F.shiftrightunsigned(F.xxhash64("class", F.lit(3)), 11).cast("double") / float(1 << 53)
        drawn = classes.join(F.broadcast(asked), ["label", "d"]).withColumn("chance", chance).where(F.col("chance") < F.col("part"))
        place = F.row_number().over(Window.partitionBy("label", "d").orderBy("chance", "class"))
        found: dict[tuple, list] = {}
        for r in drawn.withColumn("place", place).where(F.col("place") <= F.col("k")).select("label", "d", "v").collect():
            found.setdefault((r["label"], r["d"]), []).append(r["v"])
        pivots = {g: _unit(np.array(v)) for g, v in found.items() if len(v) > 1}
    sent = spark.sparkContext.broadcast(Cells(pivots, radius))

    def groups(batch: pd.DataFrame):
        for group, part in batch.groupby(["label", "d"], sort=False):
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            yield part, *sent.value.place(group, _unit(x))

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, home, visits in groups(batch):
                row, cell = np.nonzero(visits)
                yield part[["label", "d"]].iloc[row].assign(cell=cell, home=(cell == home[row]))

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, home, visits in groups(batch):
                row, cell = np.nonzero(visits)
                out = part[["label", "d", "class", "weight", "v"]].iloc[row]
                yield out.assign(cell=cell, home=(cell == home[row]))

    kind = dict(classes.dtypes)["label"]
    slim = classes.select("label", "d", "class", "weight", "v")
    seen = slim.select("label", "d", "v").mapInPandas(visited, f"label {kind}, d int, cell bigint, home boolean").groupBy("label", "d", "cell")
    count = seen.agg(F.ceil(F.count_if("home") / PART).cast("int").alias("parts"), F.ceil(F.count("*") / AGAINST).cast("int").alias("blocks"))
    # A cell that only guests visit has nobody to find links for.
    grid = scratch.table(count.where("parts > 0"), "grid")
    copied = slim.mapInPandas(copies, f"label {kind}, d int, class bigint, weight bigint, v array<double>, cell bigint, home boolean")
    dealt = deal(copied, grid)

    def joined(cell: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(cell["v"].to_numpy()).astype(np.float64)
        # Scaling by a power of two changes no cosine and keeps squares of extreme components finite.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        ids, home = cell["class"].to_numpy(), cell["home"].to_numpy()
        links, root = link_within(x, ids, cell["weight"].to_numpy(), home, cell["other"].to_numpy(), threshold)
        told = home | (root != ids)
        return pd.DataFrame({"class": ids[told], "links": np.where(home, links, -1)[told], "root": root[told]})

    pairs = scratch.table(dealt.groupBy("label", "d", "cell", "part", "block").applyInPandas(joined, "class bigint, links bigint, root bigint"), "pairs")
    linked = components(pairs.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    counts = pairs.where("links >= 0").groupBy("class").agg(F.sum("links").alias("links"))
    rooted = scratch.table(
        classes.select("class", "id").join(counts, "class").join(linked.withColumnRenamed("node", "class"), "class", "left").select("class", "id", "links", F.coalesce("root", "class").alias("root")), "rooted"
    )
    least = scratch.table(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = scratch.table(rooted.join(least, "root").select("class", "links", "component_id"), "named")
    scratch.drop("classes", "grid", "pairs", "parents", "rooted", "least")
    keyed = rows.select("id", F.when(F.col("valid"), F.xxhash64("label", "v")).alias("class"))
    # Rows outside any class get keys of their own, so that they do not meet in one task.
    loose = keyed.where("class IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    tight = keyed.where("class IS NOT NULL").join(named, "class").select("id", F.col("links").alias("n_links"), "component_id")
    out = tight.union(loose)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
