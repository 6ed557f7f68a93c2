"""Merkle manifest of a dataset: only every few levels are stored, what lies between is recomputed for proofs and dropped.

A leaf is the digest of a row's fields, leaves are ordered within their group, and every two nodes
make one of the next level; a last node without a partner is hashed alone. Digests are lowercase hex texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.operators.ranking import global_rank

#: Levels from one stored level to the next: an aligned subtree has at most 2 ** STRIDE stored descendants.
STRIDE = 8

NODE = "tree bigint, at bigint, n bigint, node string"
PATH = "tree bigint, at bigint, before array<string>, after array<string>"


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _levels(nodes: list[str], n: int, stride: int) -> list[list[str]]:
    """The nodes of an aligned subtree, whose level has ``n``, and the levels above them up to the next stored one."""
    rows = [nodes]
    for _ in range(min(stride, int(n - 1).bit_length())):
        last = rows[-1]
        rows.append([hashlib.sha256("".join(last[k : k + 2]).encode()).hexdigest() for k in range(0, len(last), 2)])
    return rows


def _subtrees(level: DataFrame, stride: int, *carried: str) -> DataFrame:
    """One row per aligned subtree: (tree, at, n, below), ``below`` its stored descendants in order, a bounded list."""
    member = F.struct(*dict.fromkeys(["at", "node", *carried]))
    return level.groupBy("tree", F.shiftright("at", stride).alias("at")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("below"))


def climb(leaves: DataFrame, scratch: Scratch, name: str, stride: int = STRIDE) -> list[DataFrame]:
    """Stored levels over (tree, at, n, node), lowest first; the last holds one node per tree."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [_levels([b["node"] for b in r["below"]], r["n"], stride)[-1][0] for r in rows]
            left = [-(-r["n"] >> stride) if r["n"] > 1 << stride else 1 for r in rows]
            columns = [batch.column("tree"), batch.column("at"), pa.array(left, pa.int64()), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "at", "n", "node"])

    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(scratch.table(_subtrees(levels[-1], stride).mapInArrow(up, NODE), f"{name}{len(levels)}"))
    return levels


def descend(level: DataFrame, above: DataFrame, stride: int = STRIDE, **carried: str) -> DataFrame:
    """Proof paths of a stored level from those of the one ``above`` it, as (tree, at, before, after) and carried columns.

    Each aligned subtree is recomputed from its stored descendants, gives every descendant its siblings
    up to the subtree's root, and is dropped. ``before`` and ``after`` hold one entry per level, upwards: the
    digests of the run to the left and right of the path's node, empty where it has none.
    """

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                below = part.column("below").flatten()
                rows = _levels(below.field("node").to_pylist(), part.column("n")[0].as_py(), stride)
                upper = [part.column(c)[0].as_py() for c in ("before", "after")]
                before, after = [], []
                for k in range(len(below)):
                    for j, nodes in enumerate(rows[:-1]):
                        i = k >> j
                        before.append(nodes[i - 1] if i & 1 else "")
                        after.append(nodes[i + 1] if not i & 1 and i + 1 < len(nodes) else "")
                    before += upper[0]
                    after += upper[1]
                ends = np.arange(len(below) + 1, dtype=np.int32) * (len(rows) - 1 + len(upper[0]))
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, pa.string())) for v in (before, after)]
                tree = pa.array(np.full(len(below), part.column("tree")[0].as_py()), pa.int64())
                kept = [below.field(c) for c in ("at", *carried)]
                yield pa.RecordBatch.from_arrays([tree, kept[0], *lists, *kept[1:]], names=["tree", "at", "before", "after", *carried])

    more = "".join(f", {name} {kind}" for name, kind in carried.items())
    return _subtrees(level, stride, *carried).join(above, ["tree", "at"]).mapInArrow(down, PATH + more)


def _paths(levels: list[DataFrame], top: DataFrame, scratch: Scratch, name: str, stride: int) -> DataFrame:
    """Paths of the lowest stored level but one, from those of the highest."""
    paths = top
    for k in range(len(levels) - 2, 0, -1):
        paths = scratch.table(descend(levels[k], paths, stride), f"{name}{k}")
    return paths


@dataclass(frozen=True)
class Manifest:
    """Stored levels of all group trees and of the tree over their roots; ``groups`` names the trees."""

    levels: list[DataFrame]
    over: list[DataFrame]
    groups: DataFrame
    scratch: Scratch
    stride: int


def build(leaves: DataFrame, group: str, order: Sequence[Column], carry: Sequence[str], scratch: Scratch, stride: int = STRIDE) -> Manifest:
    """A manifest of rows with a ``leaf`` digest: one tree per value of ``group``, one over all of these, null first.

    Positions come from one global range sort, so a group of any size is dealt over many tasks; no
    list longer than 2 ** stride is ever gathered. Rows of equal order are taken by their digests, so the
    manifest does not depend on how rows are dealt. No rows give no tree.
    """
    rows = leaves.count()
    first = [F.asc_nulls_first(group), *order, F.asc("leaf")]
    ranked = global_rank(leaves, first, "_rank", rows)
    trees = scratch.table(ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("tree"), F.count("*").alias("n")), "trees")
    placed = ranked.join(trees, ranked[group].eqNullSafe(trees["_group"]))
    base = placed.select("tree", (F.col("_rank") - F.col("tree")).alias("at"), "n", F.col("leaf").alias("node"), *carry)
    levels = climb(scratch.table(base, "level0"), scratch, "level", stride)

    subroots = levels[-1].select("tree", "node")
    # The first rank of a tree orders the trees as their groups are ordered.
    listed = global_rank(subroots, [F.asc("tree")], "_rank", trees.count()) if rows else subroots.withColumn("_rank", F.lit(1).cast("bigint"))
    groups = scratch.table(listed.select("tree", F.col("node").alias("subroot"), (F.col("_rank") - 1).alias("at")), "groups")
    tops = groups.select(F.lit(0).cast("bigint").alias("tree"), "at", F.lit(groups.count()).cast("bigint").alias("n"), F.col("subroot").alias("node"))
    over = climb(scratch.table(tops, "over0"), scratch, "over", stride)
    return Manifest(levels, over, groups, scratch, stride)


def proofs(manifest: Manifest, **carried: str) -> DataFrame:
    """Every leaf with its proof: (leaf, subroot, root, before, after) and the carried columns (name=type).

    Interior nodes are recomputed subtree by subtree, from the root down; no node but the stored ones outlives its task.
    """
    m = manifest
    nothing = F.array().cast("array<string>")
    top = m.over[-1].select("tree", "at", nothing.alias("before"), nothing.alias("after"))
    if len(m.over) > 1:
        top = descend(m.over[0], _paths(m.over, top, m.scratch, "overpath", m.stride), m.stride)
    root = m.over[-1].select(F.col("node").alias("root")).first()
    roots = m.scratch.table(top.select("at", "before", "after").join(m.groups, "at").select("tree", F.lit(0).cast("bigint").alias("at"), "before", "after"), "rootpaths")
    if len(m.levels) > 1:
        leaves = descend(m.levels[0], _paths(m.levels, roots, m.scratch, "path", m.stride), m.stride, node="string", **carried)
    else:
        leaves = m.levels[0].join(roots, ["tree", "at"])
    named = leaves.join(m.groups.select("tree", "subroot"), "tree")
    return named.select(F.col("node").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), "before", "after", *carried)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    steps = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["b"], node, s["a"]).cast("binary"), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "").cast("binary"), 256)


def verified_rows(docs: DataFrame) -> DataFrame:
    """A manifest of documents, and each row's proof held against the row as found: some are tampered with to show it.

    Leaves hold doc_id, source, lang, n_chars and text; one tree per ``lang``, by ``doc_id``, null first. Rows with equal
    ids go by their digests, rows equal in all fields are interchangeable. Where 7 divides the CRC-32 of the
    decimal id, a presented row counts one character more; a null count or id stays as it is, so its row is
    verified. Other columns are left out. No documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))

    def digest(count: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), count, F.col("text"))

    # Texts end here: all that follows moves digests.
    same = shown.eqNullSafe(F.col("n_chars"))
    hashed = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(~same, digest(shown)).alias("other"))
    leaves = scratch.table(hashed, "leaves")
    kind = dict(docs.dtypes)["doc_id"]
    manifest = build(leaves, "lang", [F.asc_nulls_first("doc_id")], ["doc_id", "other"], scratch)
    found = proofs(manifest, doc_id=kind, other="string")
    found = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("before"), F.col("after")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
