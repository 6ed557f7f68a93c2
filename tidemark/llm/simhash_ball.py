"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, computed, narrow, whole

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Shingles whose bits are counted at once, so that a huge text needs no more memory than this many.
BLOCK = 1 << 16


def _shingles(text: str, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by spaces, and where its shingles start and end there."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[: min(len(words), 1)], ends[-1:]
    return b" ".join(words), starts, ends


def simhash(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as a signed number; 0 for a text without words."""
    joined, starts, ends = _shingles(text, size)
    n, ones, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    if not n:
        return 0
    for k in range(0, n, BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), root_col: str | None = None) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits), ``component_id`` and the carried columns.

    ``root_col`` names a further column: a fingerprint of the component, which tells components apart where ids are null or repeat.

    Fingerprints that differ in at most two bits are linked. Each distinct fingerprint is sent
    to all 65 values at most one bit away; two linked ones meet at a value half way. Whatever
    meets lies within two bits of each other, so a group holds 65 fingerprints at most and the
    link to its smallest member keeps every connection. Copies share a fingerprint and are
    reduced before the shuffle, so a group of copies of any size is one row.

    Results for odd input: a null or blank text has fingerprint zero and is linked like any
    other; repeated rows and ids each keep their row; a null id is kept and never becomes a
    component's id unless the component has no other; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    source = narrow(docs, id=id_col, text=whole(f"`{text_col}`"), **kept)
    prints = scratch.table(computed(source, ["text"], "fp bigint", lambda texts: [list(map(simhash, texts))]), "prints")
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")

    ball = F.expr("explode(array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp))")
    meeting = distinct.select("fp", ball.alias("middle"))
    links = (
        meeting.withColumn("least", F.min("fp").over(Window.partitionBy("middle")))
        .where("fp <> least")
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
        .distinct()
        .where(F.bit_count(F.expr("a ^ b")) <= RADIUS)
    )
    found = components(links, scratch).select(F.col("node").alias("fp"), "root")
    rooted = scratch.table(distinct.join(found, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.table(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = scratch.table(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    scratch.drop("distinct", "parents", "rooted", "least")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *(F.col(n).alias(c) for n, c in kept.items()),
        *([F.col("root").alias(root_col)] if root_col else []),
    )


#: The wide fingerprint: 256 bits as four numbers, each with three parts of 26 bits that have balls of their own.
WORDS, PART, OFFSETS = 4, 26, (0, 19, 38)
WIDE_SHINGLE = 5


def wide_simhash(text: str, size: int = WIDE_SHINGLE) -> list[int]:
    """A fingerprint of 256 bits, as four signed numbers; zeros for a text without words."""
    joined, starts, ends = _shingles(text, size)
    n, ones, digest = len(starts), np.zeros(64 * WORDS, np.int64), xxhash.xxh3_128_digest
    for k in range(0, n, BLOCK // WORDS):
        cut = [joined[s:e] for s, e in zip(starts[k : k + BLOCK // WORDS].tolist(), ends[k : k + BLOCK // WORDS].tolist())]
        hashes = b"".join([digest(c, SEED) + digest(c, SEED + 1) for c in cut])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(len(cut), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).view("<i8").tolist()


def most_bits(similarity: float, bits: int) -> int:
    """In how many bits texts of this Jaccard similarity differ: what is expected, and two standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), root_col: str = "root", similarity: float = 0.8
) -> DataFrame:
    """One row per input row: its id, ``root_col`` (a number that tells its group) and the carried columns.

    Texts are linked whose wide fingerprints, of shingles of five words, differ in no more bits than those of texts of
    this similarity do. Candidates meet by ball hashing of the fingerprint's parts: each part is sent to all values
    within one bit, so two texts meet if any part differs in two bits at most. Of texts that meet at one value, each is
    paired with the first and with the one before it, so a value where many meet makes two pairs a
    text; and as the values are range-sorted together with the fingerprints, many tasks share it. All pairs are
    verified by their 256 bits. Copies are reduced before the balls.

    Which links are found is a matter of chance: two texts of similarity 0.8 meet with a chance of 0.95, of 0.9 with
    more than 0.99; larger groups hold together by more than one pair. Null and blank texts are one group; repeated rows, null ids and repeated ids keep
    their rows; texts of fewer than five words are one shingle; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    names = [f"f{k}" for k in range(WORDS)]
    source = narrow(docs, id=id_col, text=whole(f"`{text_col}`"), **kept)

    def prints_of(texts: list[str]) -> list:
        return list(zip(*map(wide_simhash, texts))) or [[]] * WORDS

    prints = scratch.table(computed(source, ["text"], ", ".join(f"{n} bigint" for n in names), prints_of), "prints")
    rest = F.min(F.struct(*names[1:])).alias("rest")  # texts alike in all 64 bits of the first number are one
    distinct = scratch.table(prints.groupBy("f0").agg(rest).select("f0", "rest.*"), "distinct")

    mask = (1 << PART) - 1
    parts = [f"(shiftright({n}, {at}) & {mask}L) | {len(OFFSETS) * i + k << PART}L" for i, n in enumerate(names) for k, at in enumerate(OFFSETS)]
    balls = F.expr(f"explode(flatten(transform(array({', '.join(parts)}), p -> array_append(transform(sequence(0, {PART - 1}), i -> p ^ shiftleft(1L, i)), p))))")
    meeting = distinct.select(balls.alias("middle"), "f0").repartitionByRange("middle", "f0").sortWithinPartitions("middle", "f0")
    met = scratch.table(meeting.mapInArrow(_meet, "a bigint, b bigint, middle bigint, task int"), "met")
    ends = met.where("task IS NOT NULL").select("a", "middle", "task", "b")  # the first (b = 0) and last (b = 1) row of each task
    order = Window.orderBy("task", "b")  # two rows per task that had rows
    across = (
        ends.withColumn("before", F.lag("a").over(order)).withColumn("same", F.lag("middle").over(order) == F.col("middle"))
        .where("b = 0 AND same AND a <> before").select("a", F.col("before").alias("b"))
    )
    pairs = met.where("task IS NULL").select("a", "b").union(across).distinct()
    for end in "ab":
        pairs = pairs.join(distinct.select(F.col("f0").alias(end), *(F.col(n).alias(end + n) for n in names[1:])), end)
    apart = F.bit_count(F.expr("a ^ b"))
    for n in names[1:]:
        apart += F.bit_count(F.expr(f"a{n} ^ b{n}"))
    links = pairs.where(apart <= most_bits(similarity, 64 * WORDS)).select("a", "b")
    found = scratch.table(components(links, scratch), "found")
    scratch.drop("distinct", "met", "parents")
    out = prints.join(found, prints["f0"] == found["node"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "f0").alias(root_col), *(F.col(n).alias(c) for n, c in kept.items()))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted rows that share a value: each row with the one before it and with the value's first in this task.

    Pairs whose first numbers alone are too far apart (three standard deviations) are left out. The task's own first and last row follow.
    """
    task = TaskContext.get().partitionId()
    share = math.acos(8 / 9) / math.pi
    most = int(64 * share + 3 * math.sqrt(64 * share * (1 - share)))
    first, last, lead = None, None, None  # the task's first row, the row before this batch, the first row of its value
    for batch in batches:
        middle, f = (np.asarray(batch.column(k)) for k in range(2))
        if not len(middle):
            continue
        if last is None:
            first = last = (middle[0], f[0])
            lead = f[0]
        m, g = np.concatenate([[last[0]], middle]), np.concatenate([[last[1]], f])
        same = m[1:] == m[:-1]
        at = np.maximum.accumulate(np.where(same, -1, np.arange(len(f))))
        heads = np.where(at < 0, lead, f[np.maximum(at, 0)])
        a = np.concatenate([f[same], f[same]])
        b = np.concatenate([g[:-1][same], heads[same]])
        near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= most)
        made = np.unique(np.stack([a[near], b[near]], 1), axis=0)
        last, lead = (middle[-1], f[-1]), heads[-1]
        yield _rows(made[:, 0], made[:, 1], None, None)
    if first is not None:
        yield _rows([first[1], last[1]], [0, 1], [first[0], last[0]], [task, task])


def _rows(a, b, middle, task) -> pa.RecordBatch:
    n = len(a)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    columns = [pa.nulls(n, k) if v is None else pa.array(np.asarray(v), k) for v, k in zip((a, b, middle, task), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "middle", "task"])
