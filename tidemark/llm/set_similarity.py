"""Near copies by the exact Jaccard similarity of their sets of word shingles: prefix filter, bounds, verified links."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, computed, narrow, whole
from tidemark.session import BROADCAST_BYTES

SHINGLE, SEED = 5, 42
#: Odd factors of a shingle's words, by their place.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)
#: One text in SAMPLED tells which shingles are frequent, if so many of those texts hold one; of them the most frequent LISTED are known to all tasks.
#: The order decides how much is compared, never what is found.
SAMPLED, FREQUENT, LISTED = 16, 4, 1 << 17
#: Numbers of 64 bits that bound the overlap of two sets.
PARITIES = 4
#: Rounds in which each text is compared with two of every shingle's texts, before all that are still apart are compared.
ROUNDS = 3
#: Bytes that a key takes in a table sent to all tasks.
KEY_BYTES = 32


def shingles(text: str) -> np.ndarray:
    """The set of a text's shingles of five words, as sorted 64-bit hashes; a text of fewer words is one shingle, none is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    for k, factor in enumerate(FACTORS):
        mixed += each[k : k + n] * factor
    mixed ^= mixed >> np.uint64(29)
    mixed *= FACTORS[-1]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix_size(n: int, similarity: Fraction) -> int:
    """How many first shingles, in an order that all sets share, hold a common one of any similar set."""
    return n - -(-similarity.numerator * n // similarity.denominator) + 1 if n else 0


def rarest_first(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, counts = frequent
    if not len(known):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]


def parities(found: np.ndarray, numbers: int = PARITIES) -> np.ndarray:
    """Of each of 64 classes of shingles a number, whether a set holds an odd number of them: sets differ in at least as many shingles as bits."""
    odd = np.bincount((found & np.uint64(64 * numbers - 1)).astype(np.int64), minlength=64 * numbers) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def fine_parities(found: np.ndarray) -> np.ndarray:
    """The same by at least two classes a shingle, a power of two: half the numbers are those of both halves, exclusive or."""
    return parities(found, 1 << max(0, (2 * len(found) - 1).bit_length() - 6))


def _fine_apart(a: str, b: str) -> Column:
    """Bits in which fine parities differ, by the classes of the smaller; none is told of more than twice as many."""
    k = F.least(F.size(a), F.size(b))

    def folded(x: str) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(F.coalesce(q, F.lit(0))))

    bits = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * k, F.aggregate(bits, F.lit(0), lambda n, more: n + more)).otherwise(0)


def _meeting(part: Fraction):
    """Of rows sorted by shingle, those whose text may reach the similarity with another one of the shingle's.

    A text whose shingle stands at a place can reach only texts up to some size. A batch's first and last
    shingle may go on in others and pass as they are.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h, size, pos = (batch.column(k).to_numpy() for k in (0, 2, 3))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            of = np.repeat(np.arange(len(first)), count)
            size = size.astype(np.int64)
            most = (size - pos) * (part.numerator + part.denominator) // part.numerator - size
            reaches = _of_others(-size, first, of)  # less the least size of the others
            keep = (count[of] > 1) & (-reaches <= most) & (_of_others(most, first, of) >= size)
            yield batch.filter(pa.array(keep | (of == 0) | (of == of[-1])))

    return run


def _of_others(values: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each value the greatest of its run, not counting itself."""
    greatest = np.maximum.reduceat(values, first)
    order = np.lexsort((values, of))
    top = order[np.append(first[1:], len(values)) - 1]  # the place of one that is greatest
    rest = values.copy()
    rest[top] = np.iinfo(np.int64).min // 2
    out = greatest[of]
    out[top] = np.maximum.reduceat(rest, first)
    return out


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), root_col: str = "root", similarity: float = 0.8
) -> DataFrame:
    """One row per input row: its id, ``root_col`` (a number that tells its group) and the carried columns.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles reaches ``similarity``, which is
    computed from the whole sets; a group is what hangs together by such links, and none between groups is left out.
    Two similar sets share one of their first shingles (a fifth of all, for 0.8) in an order of rarest first. Of the texts that meet at a
    shingle only those in different groups are compared: for a few rounds each with two others, which joins most of
    a large group, then all that are still apart, unless sizes, the shingles' places or
    parities bound their overlap below what is needed. No step holds a group or a shingle's texts in memory.

    Null and blank texts are one group; texts are told apart by 64 bits of their SHA-256; repeated rows, null ids and
    repeated ids keep their rows; an empty table gives no rows.
    """
    spark, part = docs.sparkSession, Fraction(str(similarity))
    scratch = Scratch(spark, "sets")
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    key = F.conv(F.substring(F.sha2(whole(f"`{text_col}`"), 256), 1, 16), 16, -10).cast("bigint").alias("key")
    texts = narrow(docs, text=whole(f"`{text_col}`")).select(F.conv(F.substring(F.sha2("text", 256), 1, 16), 16, -10).cast("bigint").alias("key"), "text")

    sampled = computed(texts.where(F.pmod("key", F.lit(SAMPLED)) == 0), ["text"], "found array<bigint>", lambda t: [[shingles(x).view(np.int64) for x in t]])
    often = sampled.dropDuplicates(["key"]).select(F.explode("found").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {FREQUENT}")
    listed = sorted((r["h"] & (1 << 64) - 1, r["n"]) for r in often.orderBy(F.desc("n"), "h").limit(LISTED).collect())
    frequent = spark.sparkContext.broadcast((np.array([h for h, _ in listed], np.uint64), np.array([n for _, n in listed], np.int64)))

    marks = [f"m{k}" for k in range(PARITIES)]

    def first(texts: list[str]) -> list:
        sets = [shingles(t) for t in texts]
        firsts = [rarest_first(s, frequent.value)[: prefix_size(len(s), part)] for s in sets]
        coarse = np.array([parities(s) for s in sets], np.int64).reshape(-1, PARITIES).T.tolist()
        return [[len(s) for s in sets], [f.view(np.int64) for f in firsts], *coarse, [fine_parities(s) for s in sets]]

    sizes = computed(texts, ["text"], ", ".join(["size int, first array<bigint>", *(f"{m} bigint" for m in marks), "fine array<bigint>"]), first)
    distinct = scratch.table(sizes.groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "first", *marks, "fine"))), "first")
    spread = distinct.select("key", "size", F.posexplode("first").alias("pos", "h")).select("h", "key", "size", "pos")
    ordered = spread.repartitionByRange("h", "key").sortWithinPartitions("h", "key")
    rows = scratch.table(ordered.mapInArrow(_meeting(part), "h bigint, key bigint, size int, pos int"), "rows")

    marked = scratch.table(distinct.drop("first").join(rows.select("key").distinct(), "key", "left_semi"), "marks")
    scratch.drop("first")

    def may_link(a: str, b: str) -> Column:
        """Whether the overlap may reach its need, by what is left behind the places."""
        behind = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
        return _reaches(behind, F.col(f"{a}.size") + F.col(f"{b}.size"), part)

    def may_overlap(a: str, b: str) -> Column:
        """The same by half of what the parities leave."""
        apart = [F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in marks]
        both = F.col(f"{a}.size") + F.col(f"{b}.size")
        return _reaches(F.floor((both - sum(apart[1:], apart[0])) / 2), both, part)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that are similar. Sets are made and shuffled only of texts that both coarse and fine parities leave open."""
        for end in "ab":
            pairs = pairs.join(marked.select(F.col("key").alias(end), F.struct("size", *marks).alias(f"x{end}")), end)
        pairs = pairs.where(may_overlap("xa", "xb"))
        for end in "ab":
            pairs = pairs.join(marked.select(F.col("key").alias(end), F.col("fine").alias(f"f{end}")), end)
        both = F.col("xa.size") + F.col("xb.size")
        pairs = pairs.where(_reaches(F.floor((both - _fine_apart("fa", "fb")) / 2), both, part))
        pairs = scratch.replace(pairs.select("a", "b"), "pairs")
        keys = scratch.replace(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
        few = keys.count() * KEY_BYTES <= BROADCAST_BYTES
        needed = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"])
        sets = scratch.replace(computed(needed, ["text"], "found array<bigint>", lambda t: [[shingles(x).view(np.int64) for x in t]]), "sets")
        for end in "ab":
            pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("found").alias(f"s{end}")), end)
        overlap = F.size(F.array_intersect("sa", "sb"))
        return pairs.where(_reaches(overlap, F.size("sa") + F.size("sb"), part)).select("a", "b")

    links = spark.createDataFrame([], "a bigint, b bigint")
    found = spark.createDataFrame([], "node bigint, root bigint")

    def apart() -> DataFrame:
        """Rows of shingles whose texts are of different groups."""
        rooted = rows.join(found, rows["key"] == found["node"], "left").select(rows["*"], F.coalesce("root", "key").alias("root"))
        same = Window.partitionBy("h")
        return rooted.withColumns({"least": F.min("root").over(same), "most": F.max("root").over(same)}).where("least < most").drop("least", "most")

    def linked(pairs: DataFrame) -> bool:
        """Adds the links among pairs; whether there were any."""
        nonlocal links, found
        more = scratch.replace(verified(pairs), "more")
        if more.isEmpty():
            return False
        links = scratch.replace(links.union(more).distinct(), "linked")
        found = scratch.replace(components(links, scratch), "found")
        return True

    item = F.struct("key", "root", "size", "pos")
    for round_ in range(ROUNDS):
        order = Window.partitionBy("h").orderBy(F.xxhash64("key", F.lit(round_)), "key")
        others = F.array(F.lag("x").over(order), F.first("x").over(order))
        met = apart().withColumn("x", item).withColumn("others", others).select("x", F.explode("others").alias("y"))
        near = met.where((F.col("x.root") != F.col("y.root")) & may_link("x", "y"))
        if not linked(near.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()):
            break
    live = scratch.table(apart().join(marked.select("key", *marks), "key"), "live")
    x, y = live.alias("x"), live.alias("y")
    cross = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root")) & may_link("x", "y") & may_overlap("x", "y"))
    linked(cross.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct())
    scratch.drop("sets", "marks", "rows", "live", "pairs", "keys", "more", "linked", "parents")

    blank = F.length(F.regexp_replace(whole(f"`{text_col}`"), r"[\x20\x09-\x0D]+", "")) == 0
    named = docs.select(F.when(~blank, key).alias("key"), F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").alias(n) for n, c in kept.items()))
    out = named.join(found, named["key"] == found["node"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "key", F.lit(0).cast("bigint")).alias(root_col), *(F.col(n).alias(c) for n, c in kept.items()))


def _reaches(overlap: Column, both: Column, part: Fraction) -> Column:
    """Whether sets of so many shingles together, with so many in common, are similar: in whole numbers."""
    return overlap * (part.numerator + part.denominator) >= both * part.numerator
