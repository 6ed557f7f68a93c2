"""Long repeats across documents, found over suffixes in buckets with ranks of a sparse cover.

A suffix whose first ``length`` bytes also start elsewhere marks those bytes. The method is blockwise suffix
sorting with a cover sample: suffixes are dealt into buckets, a bucket is settled on its own, and
ties longer than a block are settled by ranks that were worked out beforehand for the sample's positions.

The cover. A difference cover of period v holds, for any two positions, a shift below v that brings both into
the sample; it samples some sqrt(v) / v of all bytes, whatever they hold. Here the sample is chosen by content: in every
``length``-byte string the place of its least gram (windowed minimum, leftmost on ties). Two equal strings have it at the
same shift, which is all that the method needs, and one byte in 100 to 200 is sampled instead of one in 13.

1. Sample: a gram that occurs once in the corpus settles all suffixes that it covers (no repeat).
2. Ranks: suffixes covered by one sampled place fall into blocks of BLOCK starts, aligned to that place. All strings
   of a block share ``length - BLOCK + 1`` bytes, the block's core; a core's rank is its 128-bit hash. Equal suffixes lie in
   blocks of equal core rank: the buckets. A core that occurs once settles its block (no repeat); a block that
   occurs twice with all its bytes settles it too (all repeat).
3. Ties: only buckets that hold different blocks are taken apart, suffix by suffix, each keyed by its full string's rank.

Ranks are two independent 64-bit polynomial hashes, computed in place: equality of both stands for equal bytes, and nothing
rests on 64 bits alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, computed, whole

LENGTH = 400
BLOCK = 32
#: Starts handled at once: bounds the memory that a huge document takes.
CHUNK = 1 << 20
#: Rows that leave a task at once.
ROWS = 1 << 16
_BITS = 24
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random values of the bytes and odd multipliers, the same in every process.
VALUES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of any substrings of one piece of text, in constant time each."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, lane: int):
        up, self.down = self._powers(lane, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUES[lane][raw] * up[: len(raw)], out=self.sums[1:])

    @classmethod
    def _powers(cls, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.powers.get(lane)
        if have is None or len(have[0]) < n:
            size, factor = max(n, 1 << 16), FACTORS[lane]
            up, down = np.full(size, factor, np.uint64), np.full(size, pow(factor, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = cls.powers[lane] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        return have[0][:n], have[1][:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def gram_size(length: int) -> int:
    return max(1, length // 3)


def windowed_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys: minima from both ends of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def chunks(raw: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that hold CHUNK starts of whole strings each; empty if it is too short for one."""
    for base in range(0, len(raw) - length + 1, CHUNK):
        yield base, raw[base : base + CHUNK + length - 1]


def sample(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of a chunk: first and last start that each covers, the place, its gram's hash."""
    gram = gram_size(length)
    at = np.arange(len(raw) - gram + 1)
    hashes = Rolling(raw, 0).of(at, at + gram)
    low = np.uint64((1 << _BITS) - 1)
    least = windowed_least((hashes & ~low) | at.astype(np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return first, last, place[first], hashes[place[first]]


def blocks(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the covered starts, aligned to the place: first start, last start, start of the core."""
    # Block b holds the starts from b * BLOCK to b * BLOCK + BLOCK - 1 bytes before the place.
    near, far = (place - last) // BLOCK, (place - first) // BLOCK
    count = far - near + 1
    owner = np.repeat(np.arange(len(first)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[owner]
    core = place[owner] - b * BLOCK
    return np.maximum(first[owner], core - BLOCK + 1), np.minimum(last[owner], core), core


def _raw(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


class Columns:
    """Arrays gathered text by text, with the text's key repeated; one frame per batch."""

    def __init__(self, names: str):
        self.names, self.parts, self.keys, self.counts, self.rows = names.split(), [], [], [], 0

    def add(self, key: bytes, *arrays: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(arrays[0]))
        self.rows += len(arrays[0])
        self.parts.append(arrays)

    def full(self) -> Iterator[pd.DataFrame]:
        """A frame whenever enough has come together, so that a batch of texts is never held as rows at once."""
        if self.rows >= ROWS:
            yield self.frame()
            self.parts, self.keys, self.counts, self.rows = [], [], [], 0

    def frame(self) -> pd.DataFrame:
        keys = np.empty(len(self.keys), object)
        keys[:] = self.keys
        out = {"key": np.repeat(keys, self.counts)}
        for k, name in enumerate(self.names):
            out[name] = np.concatenate([np.empty(0, np.int64), *(p[k] for p in self.parts)])
        return pd.DataFrame(out)


def _grams(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = Columns("gram")
            for key, text in zip(batch["key"], batch["text"]):
                for _, raw in chunks(_raw(text), length):
                    out.add(key, sample(raw, length)[3].view(np.int64))
                    yield from out.full()
            yield out.frame()

    return run


def _blocks(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = Columns("start n core0 full0 core1 full1")
            for key, text, wanted in zip(batch["key"], batch["text"], batch["grams"]):
                for base, raw in chunks(_raw(text), length):
                    first, last, place, gram = sample(raw, length)
                    some = np.isin(gram.view(np.int64), wanted)
                    if not some.any():
                        continue
                    a, b, core = blocks(first[some], last[some], place[some])
                    shape = ((b - a) << 8 | (core - b)).astype(np.uint64)  # a block cut short differs from a whole one
                    ranks = []
                    for lane in (Rolling(raw, 0), Rolling(raw, 1)):
                        ranks.append(lane.of(core, core + length - BLOCK + 1).view(np.int64))
                        ranks.append((lane.of(a, b + length) ^ (shape * np.uint64(FACTORS[0]))).view(np.int64))
                    out.add(key, a + base, b - a + 1, *ranks)
                    yield from out.full()
            yield out.frame()

    return run


def _strings(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = Columns("start weight h0 h1")
            for key, text, todo in zip(batch["key"], batch["text"], batch["todo"]):
                spans = np.array([(s["start"], s["n"], s["weight"]) for s in todo], np.int64)
                for base, raw in chunks(_raw(text), length):
                    mine = spans[(spans[:, 0] >= base) & (spans[:, 0] < base + CHUNK)]
                    if not len(mine):
                        continue
                    owner = np.repeat(np.arange(len(mine)), mine[:, 1])
                    at = np.arange(len(owner)) - np.repeat(np.cumsum(mine[:, 1]) - mine[:, 1], mine[:, 1]) + mine[owner, 0] - base
                    out.add(key, at + base, mine[owner, 2], *(Rolling(raw, k).of(at, at + length).view(np.int64) for k in (0, 1)))
                    yield from out.full()
            yield out.frame()

    return run


def removed_runs(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings at runs of starts ``(start, n)``; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans):
        end = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def text_key(raw: Column) -> Column:
    """128 bits of the SHA-256 of a text: its identity."""
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def repeat_starts(docs: DataFrame, text: Column, length: int, scratch: Scratch) -> DataFrame:
    """``(key, spans)``: by key of the text, the runs ``(start, n)`` of starts whose string also starts elsewhere.

    Equal texts share a key and a row. Texts without such a start are absent. Counts are combined before each shuffle,
    so a passage found in any part of all documents is one row per task; lists are bounded by their own text.
    """
    raw = text.cast("binary")
    # Texts shorter than one string hold no start and match nothing.
    bytes_ = docs.where(F.octet_length(text) >= length).select(text_key(raw).alias("key"), raw.alias("text"))
    grams = scratch.table(bytes_.mapInPandas(_grams(length), "key binary, gram bigint"), "grams")
    # Written, so that the join that follows has a plain shuffle on either side and its hot keys can be split.
    often = scratch.table(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    wanted = grams.join(often, "gram").distinct().groupBy("key").agg(F.collect_list("gram").alias("grams"))
    cut = scratch.table(
        bytes_.join(wanted, "key").mapInPandas(_blocks(length), "key binary, start bigint, n int, core0 bigint, full0 bigint, core1 bigint, full1 bigint"), "blocks"
    )
    core, full = ["core0", "core1"], ["core0", "core1", "full0", "full1"]
    # One row per different block: how often it occurs and where it does first.
    kinds = scratch.table(cut.groupBy(*full).agg(F.count("*").alias("count"), F.min(F.struct("key", "start")).alias("at"), F.max("n").alias("n")), "kinds")
    mixed = kinds.groupBy(*core).agg(F.count("*").alias("k")).where("k > 1").select(*core)
    settled = kinds.where("count > 1").select(*full)
    all_repeat = cut.join(settled, full, "left_semi").select("key", "start", "n").distinct()
    # Different blocks of one core are taken apart: one of each kind, with its count.
    apart = kinds.join(mixed, core, "left_semi").select("at.key", "at.start", "n", F.col("count").alias("weight"))
    todo = apart.groupBy("key").agg(F.collect_list(F.struct("start", "n", "weight")).alias("todo"))
    strings = scratch.table(bytes_.join(todo, "key").mapInPandas(_strings(length), "key binary, start bigint, weight bigint, h0 bigint, h1 bigint").distinct(), "strings")
    twice = scratch.table(strings.groupBy("h0", "h1").agg(F.sum("weight").alias("w")).where("w > 1").select("h0", "h1"), "twice")
    some_repeat = strings.where("weight = 1").join(twice, ["h0", "h1"], "left_semi").select("key", "start", F.lit(1).alias("n"))
    return all_repeat.union(some_repeat).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def drop_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """All rows and columns, with ``_runs``: the ``(start, end)`` byte runs of the text to remove, in order.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
    document too; strings are judged on the input. Null and short texts have no runs; a repeated row is a repeat of
    its whole text if that is long enough; ties and copies all lose their bytes; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    text = whole(f"`{text_col}`")
    found = scratch.table(repeat_starts(docs, text, length, scratch), "spans")
    scratch.drop("grams", "often", "blocks", "kinds", "strings", "twice")
    runs = found.mapInPandas(_runs(length), "_key binary, _runs array<struct<start: bigint, end: bigint>>")
    keyed = docs.withColumn("_key", F.when(F.octet_length(text) >= length, text_key(text.cast("binary"))))
    long, short = keyed.where("_key IS NOT NULL"), keyed.where("_key IS NULL")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return long.join(runs, "_key", "left").withColumn("_runs", F.coalesce("_runs", none)).drop("_key").unionByName(short.drop("_key").withColumn("_runs", none))


def _runs(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [[{"start": int(a), "end": int(b)} for a, b in removed_runs(spans, length)] for spans in batch["spans"]]
            yield pd.DataFrame({"_key": batch["key"], "_runs": runs})

    return run


def kept_bytes(raw: bytes, runs) -> bytes:
    out, at = [], 0
    for run in runs:
        out.append(raw[at : run["start"]])
        at = run["end"]
    return b"".join([*out, raw[at:]])


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept_text``; see drop_repeats.

    The digest is that of the kept bytes; in the text, a character that was cut in two is left out.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), whole(f"`{text_col}`").alias("text"))
    marked = drop_repeats(source, "text", length)
    touched = F.size("_runs") > 0
    # Texts that lose nothing stay in the JVM.
    clean = marked.where(~touched).select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept_text"))

    def digest(texts, runs):
        kept = [kept_bytes(t, r) for t, r in zip(texts, runs)]
        return [[hashlib.sha256(k).hexdigest() for k in kept], [k.decode("utf-8", "ignore") for k in kept]]

    lost = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    cut = marked.where(touched).select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("_runs").cast("long").alias("n_spans"), F.col("text").cast("binary").alias("text"), "_runs"
    )
    done = computed(cut, ["text", "_runs"], "kept_sha256 string, kept_text string", digest)
    return clean.unionByName(done).withColumnRenamed("id", id_col)
