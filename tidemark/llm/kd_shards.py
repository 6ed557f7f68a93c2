"""K-d tree sharding by distributed weighted medians; built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, numbered_copies, whole

SHARDS = 24
BINS = 1024
#: A cut may miss its median by this part of a shard's target; a group of equal texts that weighs less stays whole.
SLACK = 0.01
#: Pieces that a shard's rows are numbered in.
RUNS = 256

#: Metadata that equal texts share: log of bytes, characters per byte, share of blanks; then what orders equal points.
DIMENSIONS = ("x0", "x1", "x2")
TIES = ("tie0", "tie1")


@dataclass
class Node:
    """Shards ``first .. first + count - 1``; an inner node's cut is a point in (dimension, tie0, tie1) order."""

    first: int
    count: int
    dimension: str = ""
    fixed: list[float] = field(default_factory=list)
    limit: float | None = None
    left: Node | None = None
    right: Node | None = None
    low: float | None = None
    high: float | None = None
    goal: float = 0.0

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.dimension, *TIES)

    def goes_left(self) -> Column:
        """Lexicographic: below the fixed values, or at them and up to the limit."""
        at = F.col(self.keys[len(self.fixed)])
        left = at <= F.lit(self.limit) if self.limit is not None else F.lit(False)
        for key, value in reversed(list(zip(self.keys, self.fixed))):
            left = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & left)
        return left

    def number(self, leaves: bool) -> Column:
        """A row's node: the first shard of the node that it has reached so far."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(self.goes_left(), self.left.number(leaves)).otherwise(self.right.number(leaves))


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(f"`{text_col}`")
    doc_id = F.col(f"`{id_col}`")
    unit = lambda h: (F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53))
    rows = docs.select(doc_id.alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), F.char_length(text).cast("long").alias("chars"))
    return rows.select(
        "id",
        (F.col("bytes") + 8).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
        F.log2(F.col("bytes") + 8.0).alias("x0"),
        F.coalesce(F.col("chars") / F.expr("nullif(bytes, 0)"), F.lit(1.0)).alias("x1"),
        F.coalesce(1 - F.char_length(F.replace("text", F.lit(" "), F.lit(""))) / F.expr("nullif(chars, 0)"), F.lit(0.0)).alias("x2"),
        unit(F.xxhash64("text")).alias("tie0"),
        unit(F.xxhash64("id", F.lit(7))).alias("tie1"),
        F.lit(0).cast("long").alias("copy"),
        F.spark_partition_id().alias("part"),
    )


def _parted(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Points whose rows can all be told apart: equal rows are numbered, and the number counts in their last tie."""
    same = ["id", "crc", "tie0", "size"]
    copied = scratch.table(points.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"c_{c}") for c in same]), "copied")
    if copied.isEmpty():
        return points
    meets = points["id"].eqNullSafe(copied["c_id"])
    for c in same[1:]:
        meets &= points[c] == copied[f"c_{c}"]
    numbered = numbered_copies(points.join(copied, meets, "left_semi").drop("copy"), same, "part", "copy")
    tie = F.shiftrightunsigned(F.xxhash64("id", F.lit(7), "copy"), 11).cast("double") / float(1 << 53)
    singles = points.join(copied, meets, "left_anti")
    return scratch.replace(singles.unionByName(numbered.withColumn("tie1", tie).select(*points.columns)), "points")


def _splits(points: DataFrame, shards: int) -> Node:
    """The tree, a level at a time: all open nodes share each pass over the points.

    What comes to the driver is one row per node, or per node and bin: at most shards * BINS rows.
    """
    root = Node(0, shards)
    open_ = [root] if shards > 1 else []
    total = points.agg(F.sum("size")).first()[0] or 0
    spans = points.agg(*(F.min(d).alias(f"a{d}") for d in DIMENSIONS), *(F.max(d).alias(f"b{d}") for d in DIMENSIONS)).first()
    while open_ and total:
        placed = points.withColumn("node", root.number(False))
        spread = [F.min(d).alias(f"a{d}") for d in DIMENSIONS] + [F.max(d).alias(f"b{d}") for d in DIMENSIONS]
        seen = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("size"), *spread).collect()}
        for n in open_:
            if (r := seen.get(n.first)) is None:
                n.dimension, n.goal = DIMENSIONS[0], 0.0
                continue
            width = lambda d: (r[f"b{d}"] - r[f"a{d}"]) / ((spans[f"b{d}"] - spans[f"a{d}"]) or 1.0)
            n.dimension = max(DIMENSIONS, key=width)
            n.low, n.high = r[f"a{n.dimension}"], r[f"b{n.dimension}"]
            n.goal = r["size"] * ((n.count + 1) // 2) / n.count
        _cut(placed, [n for n in open_ if n.first in seen], total / shards * SLACK)
        following = []
        for n in open_:
            half = (n.count + 1) // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.count - half)
            following += [m for m in (n.left, n.right) if m.count > 1]
        open_ = following
    return root


def _cut(placed: DataFrame, nodes: list[Node], slack: float) -> None:
    """Finds every node's weighted median by histograms that narrow to the bin it falls in."""
    active = list(nodes)
    while active:
        value = bounds = None
        for n in active:
            here = F.col("node") == n.first
            for key, fixed in zip(n.keys, n.fixed):
                here &= F.col(key) == F.lit(fixed)
            at = F.col(n.keys[len(n.fixed)])
            here &= (at >= F.lit(n.low)) & (at <= F.lit(n.high))
            scaled = F.least(F.lit(BINS - 1), F.floor((at - n.low) / ((n.high - n.low) or 1.0) * BINS)).cast("int")
            value = F.when(here, at) if value is None else value.when(here, at)
            bounds = F.when(here, scaled) if bounds is None else bounds.when(here, scaled)
        binned = placed.select("node", "size", value.alias("v"), bounds.alias("bin")).where("bin IS NOT NULL")
        rows = binned.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        still = []
        for n in active:
            mine = sorted((r for r in rows if r["node"] == n.first), key=lambda r: r["bin"])
            before, limit = 0, None
            for k, r in enumerate(mine):
                if before + r["size"] < n.goal and k < len(mine) - 1:
                    before, limit = before + r["size"], r["high"]
                    continue
                phase = len(n.fixed)
                if r["size"] <= slack or (r["low"] == r["high"] and phase == len(TIES)):
                    n.limit = r["high"] if before + r["size"] - n.goal <= n.goal - before else limit
                elif r["low"] == r["high"]:
                    n.fixed.append(r["low"])
                    n.low, n.high, n.goal = 0.0, 1.0, n.goal - before
                    still.append(n)
                else:
                    n.low, n.high, n.goal = r["low"], r["high"], n.goal - before
                    n.limit = limit
                    still.append(n)
                break
        active = still


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Law ``bytes``: sizes (UTF-8 bytes plus 8; 8 for a null text) are near equal over the shards. A node is split
    along its relatively widest dimension at the weighted median that gives both sides their part of its shards.
    All dimensions come from the text, so equal texts are one point and stay together, unless
    a cut falls into a group that outweighs ``SLACK`` of a shard: it is then parted by a hash of the id,
    as sizes come first. Slots are numbered in RUNS pieces per shard, so that no task sorts a shard.

    A null id hashes like any value; repeated rows are numbered, so that a cut can part them, and each get a slot; fewer rows than shards leave
    shards empty; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    points = _parted(scratch.table(_points(docs, id_col, text_col), "points"), scratch)
    tree = _splits(points, shards)
    placed = points.select("id", "size", "crc", tree.number(True).alias("shard"), F.pmod(F.xxhash64("id", "crc", "size", "copy"), F.lit(RUNS)).alias("run"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "run", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("id", "crc", "size")
    numbered = placed.withColumn("k", F.row_number().over(within) - 1)
    # At most shards * RUNS rows of three numbers.
    slots = numbered.join(F.broadcast(offsets), ["shard", "run"])
    return slots.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
