"""Chat formatting over a prefix tree: turns that conversations share from their start on are emitted once, depth-first.

Every distinct prefix of turns is a segment. Segments follow one another in one long sequence, each
before all that continue it, with its place there, its first position id (the ids of a conversation run
from 0 along its path) and the intervals of the sequence that it may attend to besides itself: its ancestors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, computed, narrow, tokenizer, whole
from tidemark.operators.ranking import global_rank

# Strings that common chat templates give a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are learned.
LEARNED = "assistant"

#: A backslash goes behind the first character of each place where a control string starts; others are doubled.
_STARTS = "(" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + ")"

#: Segments whose lengths one task adds up.
BLOCK_BITS = 16


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class Forest:
    """The emitted segments, where each distinct conversation's turns lie among them, and where conversations end.

    segments: start, end (places in the sequence), position (first position id), learned, body_start, body_end (the text's
    span within the segment, under the loss mask if learned), ancestors (intervals in rising order), segment (text; with a
    tokenizer ids instead, and all places in ids). turns: path, k (turn from 0), start, is_end. ends: conv, start (of its last segment).
    """

    segments: DataFrame
    turns: DataFrame
    ends: DataFrame
    vocabulary: str | None


def _streamed(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Paths turn by turn: whole paths per task, rows in order, so ``run`` keeps the state of one path only."""
    return df.repartition("path").sortWithinPartitions("path", "k").mapInArrow(run, schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_BINARY, _LONG, _INTERVALS = pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_STEP = pa.schema([("k", _LONG), ("key", _BINARY), ("parent", _BINARY)])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for every prefix of a conversation, from its parent's key and its last turn's digest."""
    path, key, k = None, b"", 0
    for batch in batches:
        made = []
        for p, turn in zip(batch.column("path").to_pylist(), batch.column("turn").to_pylist()):
            k, parent = (k + 1, key) if p == path else (0, b"")
            path, key = p, hashlib.sha256(parent + turn).digest()
            made.append((k, key, parent))
        yield pa.RecordBatch.from_arrays([*batch.columns, *_batch(_STEP, made).columns], names=[*batch.schema.names, *_STEP.names])


_ORDERED = pa.schema([("key", _BINARY), ("turn", _BINARY), ("depth", _LONG), ("branches", pa.list_(_BINARY))])


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node, once: the keys on its way where siblings part. Ways sort depth-first by these, then by depth."""
    path, way = None, []
    for batch in batches:
        out = []
        for p, k, key, turn, branch, owner in zip(*(batch.column(c).to_pylist() for c in ("path", "k", "key", "turn", "branch", "owner"))):
            if p != path:
                path, way = p, []
            if branch:
                way = [*way, key]
            if owner == p:
                out.append((key, turn, k, way))
        yield _batch(_ORDERED, out)


_PLACED = pa.schema([("turn", _BINARY), ("start", _LONG), ("position", _LONG), ("ancestors", _INTERVALS)])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node, once: its first position id and its ancestors' places, neighbours joined."""
    path, position, seen = None, 0, []
    for batch in batches:
        out = []
        for p, turn, start, length, owner in zip(*(batch.column(c).to_pylist() for c in ("path", "turn", "start", "length", "owner"))):
            if p != path:
                path, position, seen = p, 0, []
            if owner == p:
                out.append((turn, start, position, [{"start": a, "end": b} for a, b in seen]))
            if seen and seen[-1][1] == start:
                seen[-1] = (seen[-1][0], start + length)
            else:
                seen.append((start, start + length))
            position += length
        yield _batch(_PLACED, out)


def _rendered(turns: DataFrame, vocabulary: str | None) -> DataFrame:
    """Each distinct turn, once: its segment, the span of its text there, and its length, in characters or token ids."""
    distinct = turns.groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit("\n"))
    made = distinct.select("turn", (F.col("role") == LEARNED).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    if vocabulary is None:
        start, length = F.char_length("head"), F.char_length("body")
        segment = F.concat("head", "body", F.lit(CLOSE))
        return made.select(
            "turn", "learned", start.alias("body_start"), (start + length).alias("body_end"), F.char_length(segment).cast("bigint").alias("length"), segment.alias("segment")
        )

    def encode(heads, bodies):
        tok = tokenizer(vocabulary)
        parts = [[e.ids for e in tok.encode_batch(x, add_special_tokens=False)] for x in (heads, bodies, [CLOSE] * len(heads))]
        ids = [a + b + c for a, b, c in zip(*parts)]
        starts, lengths = ([len(p) for p in part] for part in parts[:2])
        return [starts, [s + b for s, b in zip(starts, lengths)], [len(i) for i in ids], ids]

    return computed(made, ["head", "body"], "body_start int, body_end int, length bigint, ids array<int>", encode)


def merge_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str | None = None
) -> Forest:
    """The prefix forest of all conversations, over characters or, with a tokenizer file, over its ids.

    A conversation is the rows of one id (null: one of its own) by turn, null first; rows of equal turn go by digest and
    stay, repeated rows too. A null role or text counts as empty. Other columns are left out; no rows give an empty forest.
    Shared turns are met by joins on prefix keys, whose hot keys adaptive execution splits; the order and the places
    come from a global sort and sums over blocks of it, so a first turn of any number of conversations bounds no task.
    A path's state is that of one conversation: its branches and intervals.
    """
    scratch = Scratch(df.sparkSession, "chat")
    rows = narrow(df, conv=conv, at=turn, role=whole(F.col(f"`{role}`")), text=whole(F.col(f"`{text}`")))
    rows = rows.withColumn("turn", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    texts = scratch.table(_rendered(rows, vocabulary), "texts")

    # Only digests move from here until segments get their texts.
    path = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    listed = rows.select("conv", path.alias("path"), "at", "turn").repartition("path").sortWithinPartitions("path", F.asc_nulls_first("at"), "turn")
    kind = dict(listed.dtypes)["conv"]
    chained = listed.drop("at").mapInArrow(_chain, f"conv {kind}, path string, turn binary, k bigint, key binary, parent binary")
    steps = scratch.table(chained, "steps")
    ends = steps.groupBy("path").agg(F.first("conv").alias("conv"), F.max_by("key", "k").alias("key"))

    nodes = scratch.table(steps.groupBy("key").agg(F.min("path").alias("owner"), F.first("parent").alias("parent")), "nodes")
    # Siblings part where a node is not its parent's only child; roots always part.
    only = nodes.where(F.octet_length("parent") > 0).groupBy("parent").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    known = nodes.join(only.select("key", F.lit(False).alias("parts")), "key", "left").select("key", "owner", F.coalesce("parts", F.lit(True)).alias("branch"))
    # A node's way is read along one conversation, its owner; copies of a conversation own nothing.
    owned = steps.join(nodes.select(F.col("owner").alias("path")).distinct(), "path", "left_semi")
    ways = scratch.table(owned.select("path", "k", "key", "turn").join(known, "key"), "ways")

    ordered = _streamed(ways, _branches, "key binary, turn binary, depth bigint, branches array<binary>").join(texts.select("turn", "length"), "turn")
    ranked = global_rank(ordered.select("key", "depth", "branches", "length"), [F.asc("branches"), F.asc("depth")], "_rank", nodes.count())
    starts = scratch.table(_starts(ranked).join(ends.select("key", F.lit(True).alias("ends")).distinct(), "key", "left"), "starts")
    located = ways.join(starts.select("key", "start", "length", "ends"), "key")
    placed = _streamed(located, _intervals, "turn binary, start bigint, position bigint, ancestors array<struct<start: bigint, end: bigint>>")
    segments = placed.join(texts, "turn").withColumn("end", F.col("start") + F.col("length")).drop("turn", "length")
    segments = scratch.table(segments.repartitionByRange("start").sortWithinPartitions("start"), "segments")
    is_end = F.coalesce("ends", F.lit(False)) & (F.col("owner") == F.col("path"))
    turns = scratch.table(located.select("path", "k", "start", is_end.alias("is_end")), "turns")
    ends = scratch.table(ends.join(starts.select("key", "start"), "key").select("conv", "start"), "ends")
    scratch.drop("steps", "nodes", "ways", "starts", "texts")
    return Forest(segments, turns, ends, vocabulary)


def _starts(ranked: DataFrame) -> DataFrame:
    """Where each segment starts: lengths are added up within blocks of the order, then over blocks."""
    blocked = ranked.withColumn("_block", F.shiftright("_rank", BLOCK_BITS))
    sums = blocked.groupBy("_block").agg(F.sum("length").alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = sums.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("length").over(W.partitionBy("_block").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1))
    start = (F.col("_before") + F.coalesce(within, F.lit(0))).alias("start")
    return blocked.join(blocks, "_block").select("key", "length", start)


_READ = pa.schema([
    ("start", _LONG), ("n_turns", _LONG), ("turns_sha256", pa.string()), ("loss_chars", _LONG), ("loss_sha256", pa.string()), ("formatted_chars", _LONG),
])


def read_back(forest: Forest) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, out of the segments alone.

    Segments are read along the paths; their position ids and ancestor intervals are held against what the path
    shows, and a difference fails the run. Equal conversations are read once.
    """
    vocabulary = forest.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            out = []
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            whole_segments = columns["segment" if vocabulary is None else "ids"]
            cuts = list(zip(whole_segments, columns["body_start"], columns["body_end"]))
            parts = [[s[:a] for s, a, _ in cuts], [s[a:b] for s, a, b in cuts], [s[b:] for s, _, b in cuts]]
            if vocabulary is not None:
                parts = [tokenizer(vocabulary).decode_batch(p, skip_special_tokens=False) for p in parts]
            for i, p in enumerate(columns["path"]):
                start, end = columns["start"][i], columns["end"][i]
                head, body, tail = (p[i] for p in parts)
                if p != path:
                    path, position, seen, n, chars, loss = p, 0, [], 0, 0, 0
                    turns, learned = hashlib.sha256(), hashlib.sha256()
                if columns["position"][i] != position or [(a["start"], a["end"]) for a in columns["ancestors"][i]] != seen:
                    raise ValueError(f"the segment at {start} does not continue its path")
                text = unescape(body)
                turns.update(f"{unescape(head[len(OPEN) : -1])}\n{text}\n".encode())
                if columns["learned"][i]:
                    learned.update(text.encode())
                    loss += len(text)
                n, chars, position = n + 1, chars + len(head) + len(body) + len(tail), position + end - start
                if columns["is_end"][i]:
                    out.append((start, n, turns.hexdigest(), loss, learned.hexdigest(), chars))
                seen = [*seen[:-1], (seen[-1][0], end)] if seen and seen[-1][1] == start else [*seen, (start, end)]
            yield _batch(_READ, out)

    along = forest.turns.join(forest.segments, "start")
    schema = "start bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return forest.ends.join(_streamed(along, run, schema), "start").drop("start")
