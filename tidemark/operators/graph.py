"""Dependency graphs: edges out of code texts, closures, node selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import options_map
from tidemark.operators.ranking import global_rank
from tidemark.session import broadcast_if_small, cut_lineage

# How a code text names the tables it reads, and its option block.
REFERENCE = r"\{\{\s*ref\(['\"]([^'\"]+)['\"]\)\s*\}\}"
SOURCE = r"\{\{\s*source\(['\"]([^'\"]+)['\"],\s*['\"]([^'\"]+)['\"]\)\s*\}\}"
OPTIONS = r"(?s)\{\{\s*config\((.*?)\)\s*\}\}"

# Closure levels are merged into one table after this many, so that the plan of
# a deep graph stays short.
LEVELS_PER_MERGE = 8


def references(text: Column) -> Column:
    """Names in reference calls, in order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))


def source_pairs(text: Column) -> Column:
    """(source, table) of source calls, in order."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(SOURCE), F.lit(1)).alias("source_name"),
        F.regexp_extract_all(text, F.lit(SOURCE), F.lit(2)).alias("table_name"),
    )


def scan_models(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Name, references, sources and options of every code text."""
    name = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)$", 1), r"\.sql$", "")
    options = F.regexp_extract(F.col(text), OPTIONS, 1)
    return texts.select(
        name.alias("name"),
        F.col(path).alias("path"),
        F.col(text).alias("text"),
        references(F.col(text)).alias("refs"),
        source_pairs(F.col(text)).alias("sources"),
        options_map(options).alias("config"),
    )


def model_edges(models: DataFrame) -> DataFrame:
    """(src, dst, kind, position): what each model reads, in order of appearance."""

    def listed(names: Column, kind: str) -> Column:
        return F.transform(
            names, lambda name, i: F.struct(name.alias("src"), F.lit(kind).alias("kind"), i.alias("position"))
        )

    tables = F.transform("sources", lambda s: F.concat(s["source_name"], F.lit("."), s["table_name"]))
    edges = F.concat(listed(F.col("refs"), "model"), listed(tables, "source"))
    return models.select(F.col("name").alias("dst"), F.inline(edges)).select("src", "dst", "kind", "position")


def model_totals(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count("*").alias("model_count"),
        F.coalesce(F.sum(F.size("refs")), F.lit(0)).alias("ref_count"),
        F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("source_count"),
    )


def directory(path: Column) -> Column:
    """Everything before the last slash; ``.`` for a bare file name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def items_by_directory(models: DataFrame, item: str = "name", path: str = "path") -> DataFrame:
    """(directory, position, item): each directory's items by path, numbered from 1.

    Positions come from one global order of all paths less the first one of the
    directory, so a directory of any size is never gathered or sorted by one task.
    """
    listed = models.select(directory(F.col(path)).alias("directory"), F.col(path).alias("_path"), F.col(item).alias(item))
    ranked = global_rank(listed, [F.col("directory"), F.col("_path"), F.col(item)], "_rank", listed.count())
    first = ranked.groupBy("directory").agg(F.min("_rank").alias("_first"))
    position = (F.col("_rank") - F.col("_first") + 1).alias("position")
    return ranked.join(first, "directory").select("directory", position, item)


def layer_counts(models: DataFrame, layers: Sequence[str] = ("staging", "intermediate", "marts")) -> DataFrame:
    """Models per layer, by a word in the path; a path may count twice."""
    return models.agg(*[F.count_if(F.col("path").contains(layer)).alias(layer) for layer in layers])


@dataclass(frozen=True)
class EdgeCopy:
    """Distinct (src, dst) edges, written once: closures in either direction and from any seeds share it.

    They lie in the layout of their own exchange, by both ends, which spreads a hub's edges over all tasks.
    """

    pairs: DataFrame

    @staticmethod
    def of(edges: DataFrame | EdgeCopy) -> EdgeCopy:
        return edges if isinstance(edges, EdgeCopy) else EdgeCopy(cut_lineage(edges.select("src", "dst").distinct()))


def closure(edges: DataFrame | EdgeCopy, seeds: DataFrame, upstream: bool = False, max_depth: int | None = None) -> DataFrame:
    """(node, depth): the seeds and all they lead to along (src, dst) edges.

    Breadth-first: one join of the newest level per round, minus what is known,
    so cycles end by themselves.  The edges are copied once, or not at all if an
    ``EdgeCopy`` is given.  A level that is measured to be small is broadcast to them; a larger one is a
    shuffled join whose skewed partitions adaptive execution splits.  Reached
    nodes are combined before their exchange, so a hub that many edges point to
    is one row per task.
    """
    near, far = ("dst", "src") if upstream else ("src", "dst")
    steps = EdgeCopy.of(edges).pairs.select(F.col(near).alias("node"), F.col(far).alias("_next"))
    level = cut_lineage(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct())
    levels = [level.withColumn("depth", F.lit(0))]
    depth = 0
    while max_depth is None or depth < max_depth:
        frontier, rows = broadcast_if_small(level, "node")
        if rows == 0:
            break
        depth += 1
        reached = steps.join(frontier, "node").select(F.col("_next").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, levels).select("node")
        level = cut_lineage(reached.join(known, "node", "left_anti"))
        levels.append(level.withColumn("depth", F.lit(depth)))
        if len(levels) > LEVELS_PER_MERGE:
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def upstream(edges: DataFrame | EdgeCopy, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edges, seeds, True, max_depth)


def downstream(edges: DataFrame | EdgeCopy, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edges, seeds, False, max_depth)


# Seed sets that share a word of bits.
SETS_PER_WORD = 63
# Directions a set spreads in.
DOWN, UP = 0, 1


def _advance(steps: DataFrame, fresh: DataFrame, known: DataFrame) -> DataFrame:
    """One scan of the edges: bits that arrive at a node and are not known there."""
    keys = ["way", "node", "word"]
    arrived = steps.join(fresh, ["way", "node"]).select("way", F.col("_next").alias("node"), "word", F.col("bits").alias("_new"), F.lit(0).cast("bigint").alias("_old"))
    held = known.select(*keys, F.lit(0).cast("bigint").alias("_new"), F.col("bits").alias("_old"))
    met = arrived.unionByName(held).groupBy(*keys).agg(F.bit_or("_new").alias("_new"), F.bit_or("_old").alias("_old"))
    return met.select(*keys, F.col("_new").bitwiseAND(F.bitwise_not("_old")).alias("bits")).where("bits <> 0")


def reach(edges: DataFrame | EdgeCopy, seeds: DataFrame) -> DataFrame:
    """(node, word, bits): which seed sets reach each node, from seeds (way, node, word, bits), way ``DOWN`` or ``UP``.

    One breadth-first traversal for all sets and both ways: a node carries a bit per set, and only bits that are new
    at a node go on, so an edge is passed once per round however many sets meet on it, and cycles end by themselves.
    There are as many scans of the edges as the farthest node of any set is steps away, and one more.
    """
    pairs = EdgeCopy.of(edges).pairs
    both = F.array(*(F.struct(F.lit(w).alias("way"), F.col(a).alias("node"), F.col(b).alias("_next")) for w, a, b in ((DOWN, "src", "dst"), (UP, "dst", "src"))))
    steps = pairs.select(F.inline(both))
    keys = ["way", "node", "word"]
    fresh = cut_lineage(seeds.groupBy(*keys).agg(F.bit_or("bits").alias("bits")))
    levels = [fresh]
    while True:
        frontier, rows = broadcast_if_small(fresh, "node")
        if rows == 0:
            break
        fresh = cut_lineage(_advance(steps, frontier, reduce(DataFrame.unionByName, levels)))
        levels.append(fresh)
        if len(levels) > LEVELS_PER_MERGE:
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels).groupBy(*keys).agg(F.bit_or("bits").alias("bits")))]
    return reduce(DataFrame.unionByName, levels).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def both_directions(edges: DataFrame | EdgeCopy, seeds: DataFrame) -> DataFrame:
    """Upstream and downstream of the seeds; not the closure of either."""
    each = F.explode(F.array(F.lit(DOWN), F.lit(UP))).alias("way")
    marked = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("word"), F.lit(1).cast("bigint").alias("bits")).select("*", each)
    return reach(edges, marked).select("node")


def changed_and_downstream(edges: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed keys of a ``detect_changes`` result and all that depends on them."""
    seeds = changes.where("should_reprofile").select(F.col(key).alias("node"))
    return downstream(edges, seeds)


@dataclass(frozen=True)
class Selector:
    """One criterion over nodes: a name, ``*`` pattern, tag or path, and directions."""

    name: str | None = None
    tag: str | None = None
    path: str | None = None
    with_upstream: bool = False
    with_downstream: bool = False

    def __post_init__(self):
        if sum(x is not None for x in (self.name, self.tag, self.path)) != 1:
            raise ValueError("a selector needs a name, a tag or a path, and only one of them")


def _pattern(text: str) -> str:
    # Only the star is special; other regex characters stay live.
    return text.replace("*", ".*")


def _matches(s: Selector) -> Column:
    """Whether a node (name, path, tags) meets the selector itself; false if that is unknown."""
    if s.tag is not None:
        met = F.array_contains("tags", s.tag)
    elif s.path is not None:
        met = F.col("path").rlike(_pattern(s.path))
    elif "*" in s.name:
        met = F.col("name").rlike(f"^{_pattern(s.name)}$")
    else:
        met = F.col("name") == s.name
    return F.coalesce(met, F.lit(False))


def _seeds(nodes: DataFrame, selectors: Sequence[tuple[int, Selector]]) -> DataFrame:
    """(way, node, word, bits) of all directed selectors, by one scan of the nodes."""
    marks, named = [], []
    for number, s in selectors:
        word, bits = divmod(number, SETS_PER_WORD)
        ways = [w for w, wanted in ((DOWN, s.with_downstream), (UP, s.with_upstream)) if wanted]
        if s.name is not None and "*" not in s.name:
            # A name that is no node of the table may still have neighbours in it.
            named += [(w, s.name, word, 1 << bits) for w in ways]
        else:
            marks += [F.when(_matches(s), F.struct(F.lit(w).alias("way"), F.lit(word).alias("word"), F.lit(1 << bits).cast("bigint").alias("bits"))) for w in ways]
    found = nodes.sparkSession.createDataFrame(named, "way int, node string, word int, bits bigint")
    if marks:
        found = found.unionByName(nodes.select(F.col("name").alias("node"), F.inline(F.array_compact(F.array(*marks)))))
    return found.where(F.col("node").isNotNull())


def matching_nodes(nodes: DataFrame, edges: DataFrame | EdgeCopy, s: Selector) -> DataFrame:
    """Names of nodes the selector picks, with their upstream or downstream if it asks for them."""
    return select_nodes(nodes, edges, [s]).select("name")


def select_nodes(
    nodes: DataFrame, edges: DataFrame | EdgeCopy, include: Sequence[Selector] = (), exclude: Sequence[Selector] = ()
) -> DataFrame:
    """Nodes that match any ``include`` (all nodes without one) and no ``exclude``.

    All selectors are tried in one scan of the nodes, and all that follow edges, in either direction,
    share one traversal.
    """
    numbered = list(enumerate((*include, *exclude)))
    plain = {i: _matches(s) for i, s in numbered if not (s.with_upstream or s.with_downstream)}
    directed = [(i, s) for i, s in numbered if i not in plain]

    def any_plain(wanted: range) -> Column:
        return reduce(Column.__or__, [plain[i] for i in wanted if i in plain], F.lit(False))

    parts = {"_in": range(len(include)), "_out": range(len(include), len(numbered))}
    chosen = nodes
    if directed:
        words = range(len(numbered) // SETS_PER_WORD + 1)

        def any_bit(wanted: range) -> Column:
            masks = [sum(1 << i % SETS_PER_WORD for i, _ in directed if i in wanted and i // SETS_PER_WORD == w) for w in words]
            mask = F.element_at(F.array(*(F.lit(m).cast("bigint") for m in masks)), F.col("word") + 1)
            return F.max(F.col("bits").bitwiseAND(mask) != 0)

        reached = reach(edges, _seeds(nodes, directed)).groupBy(F.col("node").alias("name")).agg(*[any_bit(r).alias(n) for n, r in parts.items()])
        chosen = nodes.join(reached, "name", "left")
    met = {n: any_plain(r) | (F.coalesce(n, F.lit(False)) if directed else F.lit(False)) for n, r in parts.items()}
    return chosen.where((met["_in"] if include else F.lit(True)) & ~met["_out"]).select(*nodes.columns)
