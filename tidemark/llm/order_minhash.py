"""Order MinHash fingerprints; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, whole

SKETCHES, TUPLE, GRAM = 64, 2, 3
_LETTER = r"[^\x20\x09-\x0D]"
_WORD = rf"(?<!{_LETTER}){_LETTER}{{1,12}}(?!{_LETTER})"
#: Words of the text, in the only group; of longer runs every stretch of 12 characters, so that an edit leaves those beyond it alone.
PIECE = rf"(?=({_WORD}|{_LETTER}{{12}}))(?:{_WORD}|{_LETTER})"

# Values used more than once are bound as a lambda's variable, ``transform(array(value), v -> ...)[0]``:
# Spark would else work out the whole array again for each element.


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _grams(words: str, size: int) -> str:
    """Hashes of all runs of ``size`` words; of all words if they are fewer."""
    run = ", ".join(f"w[i + {k}]" for k in range(size))
    body = f"CASE WHEN size(w) = 0 THEN array() WHEN size(w) < {size} THEN array(xxhash64(w)) ELSE transform(sequence(0, size(w) - {size}), i -> xxhash64({run})) END"
    return _let("w", words, body)


def _numbered(grams: str) -> str:
    """(key, pos) of each gram, the key hashing the gram with the number of its occurrence.

    Where a gram repeats, occurrences are told apart by sorting: in the sorted list of all but first
    occurrences each points at its predecessor, and doubling the pointers finds each run's start.
    """
    simple = "transform(g, (h, i) -> struct(xxhash64(h, 0) AS key, i AS pos))"
    starts = (
        "aggregate(slice(sequence(0, 31), 1, CAST(ceil(log2(size(d) + 1)) AS INT)), "
        "transform(d, (x, i) -> IF(i > 0 AND d[greatest(i - 1, 0)].h = x.h, i - 1, i)), (p, r) -> transform(p, k -> p[k]))"
    )
    later = _let("s", starts, "transform(d, (x, i) -> struct(xxhash64(x.h, i - s[i] + 1) AS key, x.pos AS pos))")
    first = "transform(filter(o, (x, i) -> i = 0 OR o[greatest(i - 1, 0)].h <> x.h), x -> struct(xxhash64(x.h, 0) AS key, x.pos AS pos))"
    rest = _let("d", "filter(o, (x, i) -> i > 0 AND o[greatest(i - 1, 0)].h = x.h)", later)
    sorted_ = _let("o", "sort_array(transform(g, (h, i) -> struct(h AS h, i AS pos)))", f"concat({first}, {rest})")
    return _let("g", grams, f"CASE WHEN size(array_distinct(g)) = size(g) THEN {simple} ELSE {sorted_} END")


def _signature(keys: str, sketches: int, size: int) -> str:
    """For each sketch the hash of its ``size`` minimal keys in text order.

    One hash serves all sketches: sketch j orders the keys by their distance upwards, around the
    circle of 64-bit numbers, from j's mark. All marks are found in the sorted keys at once by sorting them in.
    """
    step = (1 << 64) // sketches
    marks = f"transform(sequence(0, {sketches - 1}), j -> struct(CAST(-9223372036854775808 + CAST(j AS DECIMAL(38, 0)) * {step} AS BIGINT) AS key, -1 AS pos))"
    starts = "transform(filter(transform(m, (x, i) -> struct(x.pos AS pos, i AS at)), x -> x.pos < 0), (x, j) -> x.at - j)"
    pick = f"xxhash64(transform(sort_array(transform(sequence(0, {size - 1}), e -> struct(t[(s + e) % size(t)].pos AS pos, t[(s + e) % size(t)].key AS key))), x -> x.key))"
    picked = f"transform({starts}, s -> CAST(({pick} & 4294967295) - 2147483648 AS INT))"
    body = _let("t", "filter(m, x -> x.pos >= 0)", picked)
    merged = _let("m", f"sort_array(concat(k, {marks}))", body)
    return _let("k", keys, f"CASE WHEN size(k) = 0 THEN array_repeat(-2147483648, {sketches}) ELSE {merged} END")


def signature(text: str, sketches: int = SKETCHES, size: int = TUPLE, gram: int = GRAM) -> Column:
    """The signature of a text column as numbers: near texts agree in many places.

    Two texts agree in a place if they share the same minimal grams in the same order there, so moved
    passages lower the likeness although the grams stay. Equal texts have equal signatures; a null or blank
    text has the signature of the empty one, which agrees with no other.
    """
    words = f"regexp_extract_all(coalesce({text}, ''), '{PIECE}', 1)".replace("\\", "\\\\")
    return F.expr(_signature(_numbered(_grams(words, gram)), sketches, size))


def likeness(a: str, b: str) -> Column:
    """Share of places in which two signatures agree, from 0 to 1."""
    return F.expr(f"CAST(aggregate(zip_with({a}, {b}, (x, y) -> IF(x = y, 1, 0)), 0, (n, x) -> n + x) AS DOUBLE) / size({a})")


def as_text(signature_col: str) -> Column:
    return F.expr(f"array_join(transform({signature_col}, x -> lower(lpad(hex(CAST(x AS BIGINT) + 2147483648), 8, '0'))), '')")


#: Cells of the id grid, and rows that a bucket of consecutive cells aims at.
CELLS, BUCKET_ROWS = 1 << 14, 1024


def with_next(docs: DataFrame, order: str, tie: str, *columns: str) -> DataFrame:
    """All rows with ``next_<column>`` of the row that follows by ``order`` descending, null last; after the last, the first.

    Rows are dealt to buckets of neighbouring order values, each with a copy of the row that follows its
    last one, so one shuffle serves and no task sees the whole order. The bounds of the buckets come from counts on a grid
    of at most CELLS cells, which is all that the driver sees. Rows of one order value are told apart by ``tie``.
    """
    spark = docs.sparkSession
    value = F.col(order)
    ends = docs.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    if ends["low"] is None:
        dealt = docs.withColumn("_to", F.explode(F.array(F.struct(F.lit(0).alias("b"), F.lit(0).alias("late")), F.struct(F.lit(0).alias("b"), F.lit(1).alias("late")))))
    else:
        low, width = ends["low"], max(1, -(-(ends["high"] - ends["low"] + 1) // CELLS))
        cell = F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
        counts = sorted(docs.where(value.isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.max(order).alias("top")).collect(), key=lambda r: r["cell"])
        rows, buckets, held, last = [], 0, 0, None
        for r in counts:
            if held >= BUCKET_ROWS:
                buckets, held = buckets + 1, 0
            rows.append([r["cell"], buckets])
            held, last = held + r["n"], r["top"]
            if len(rows) > 1 and rows[-2][1] != buckets:
                rows[-2].append(before)
            before = r["top"]
        # The highest value of a bucket also goes to the bucket above, whose last row it follows; the highest of all to the lowest.
        cells = spark.createDataFrame([(c, b, t[0] if t else None) for c, b, *t in rows], "_cell int, _bucket int, _top bigint")
        placed = docs.withColumn("_cell", cell).join(F.broadcast(cells), "_cell", "left").withColumn("_bucket", F.coalesce("_bucket", F.lit(0)))
        own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("late"))
        above = F.when(value == F.col("_top"), F.struct((F.col("_bucket") + 1).alias("b"), F.lit(0).alias("late")))
        around = F.when(value == F.lit(last), F.struct(F.lit(0).alias("b"), F.lit(1).alias("late")))
        dealt = placed.withColumn("_to", F.explode(F.filter(F.array(own, above, around), lambda x: x.isNotNull()))).drop("_cell")
        dealt = dealt.withColumn("_guest", (F.col("_to.b") != F.col("_bucket")) | (F.col("_to.late") == 1)).drop("_bucket", "_top")
    if ends["low"] is None:
        dealt = dealt.withColumn("_guest", F.col("_to.late") == 1)
    dealt = dealt.select("*", F.col("_to.b").alias("_b"), F.col("_to.late").alias("_late")).drop("_to")
    following = Window.partitionBy("_b").orderBy("_late", value.desc_nulls_last(), tie)
    out = dealt.select("*", *(F.lead(c).over(following).alias(f"next_{c}") for c in columns))
    return out.where(~F.col("_guest")).drop("_b", "_late", "_guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and the likeness to both the edited and the next text.

    The edited text has its last third replaced by the first characters of the next document by descending id (after the
    last: the first), as many as there are. Null texts count as empty; rows of one id follow each other by a hash of
    their texts; null ids come last; a single row is its own next one; an empty table gives no rows.
    """
    source = narrow(docs, id=id_col, text=whole(f"`{text_col}`")).withColumns({"tie": F.xxhash64("text"), "sig": signature("text")})
    pairs = with_next(source, "id", "tie", "text", "sig")
    edited = F.concat(F.expr("left(text, char_length(text) - CAST(char_length(text) DIV 3 AS INT))"), F.expr("left(next_text, CAST(char_length(text) DIV 3 AS INT))"))
    both = pairs.select("id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    done = both.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature("edited").alias("edited_sig"))
    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
