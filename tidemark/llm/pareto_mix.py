"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import COPIES_AT_ONCE, WORD, Scratch, numbered_copies, whole

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Ranks are compared on 48 bits, found 12 at a time.
LEVELS, LEVEL_BITS = 4, 12
RANK_BITS = LEVELS * LEVEL_BITS
#: Sources up to this number are broadcast with their few figures each; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``(_key, source, source_size)`` with ``target``: shares by weight, capped at ``most`` times the source.

    Sources in code point order, null last, take the weights in turn. What a cap cuts off goes to
    the others by weight until none is above its own: in order of cap over weight, the first
    source whose share of what the earlier ones leave stays below its cap fixes everybody's share.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cyclic = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("w", cyclic).withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    shared = weighed.withColumn("unit", unit).withColumn("place", F.row_number().over(by_cap))
    fits = F.when(F.col("unit") * F.col("w") <= F.col("cap") * (1 + 1e-12), F.struct("place", "unit"))
    final = shared.withColumn("unit", F.min(fits).over(everything)["unit"])
    return final.withColumn("target", F.coalesce(F.least("cap", F.col("unit") * F.col("w")), F.col("cap"))).drop("w", "cap", "unit", "place")


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MAX_COPIES,
    tilt: float = 0.1,
    seed: int = 17,
) -> DataFrame:
    """All input rows and columns, with ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    A document expects ``e = min(most, c * preference)`` copies, where the preference grows by
    ``tilt`` per doubling of its length and ``c`` makes its source's expected words meet the target.
    The whole part of ``e`` is certain. The rest ``f`` is an inclusion probability: documents
    are ranked by the odds of a random number over the odds of ``f``, and each source takes
    the lowest ranks until the words of its expected rest are reached (the sample's fixed size, in
    words, as targets are). The limit is found by descending through histograms of the ranks, 12 bits
    a time, so no source is ever sorted or gathered; its documents are only counted.

    The random number is a hash of seed, id and text: reruns agree. Rows equal in source, id and text are numbered,
    and the number is hashed as well: each has a draw of its own, and how many of them are taken does not depend on
    which is which. Null and blank texts have size 0 and count no words; a null source is
    a source of its own, last in order; a source without words has target 0 and its rows get no copy
    unless its weight asks for whole ones; an empty table gives no rows. Input columns are
    returned untouched; the new ones start with an underscore and replace any of that name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), whole(text))
    rows = docs.withColumns({"_key": key, "_size": word_count(text), "_draw": draw})
    slim = scratch.table(rows.select("_key", source.alias("source"), "_size", "_draw"), "sizes")
    octave = F.floor(F.log2(F.col("_size") + 1)).cast("int")

    hist = scratch.table(slim.groupBy("_key", "source", octave.alias("octave")).agg(F.sum("_size").alias("words")), "octaves")
    totals = hist.groupBy("_key", "source").agg(F.sum("words").alias("source_size"))
    targets = scratch.table(source_targets(totals, weights, most), "targets")
    sources = targets.count()

    # c of each source: the most preferred octaves reach the cap first.
    preference = F.col("octave") * tilt + 1.0
    high = Window.partitionBy("_key").orderBy(F.col("octave").desc())
    capped = F.coalesce(F.sum("words").over(high.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    open_ = F.sum(F.col("words") * preference).over(high.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = hist.join(_small(targets.select("_key", "target"), sources), "_key").withColumn(
        "c", F.when(open_ > 0, (F.col("target") - capped) / F.when(open_ > 0, open_))
    )
    rates = tried.groupBy("_key").agg(F.min(F.when(F.col("c") * preference <= most * (1 + 1e-12), F.struct(-F.col("octave"), "c")))["c"].alias("c"), F.max("target").alias("target"))
    # No octave below the cap: every document has its full number of copies.
    rates = rates.select("_key", F.coalesce("c", F.when(F.col("target") > 0, F.lit(1e9)).otherwise(F.lit(0.0))).alias("c"))
    params = scratch.table(targets.join(rates, "_key").select("_key", "source_size", "target", "c"), "params")

    def ranked(df: DataFrame, found: DataFrame) -> DataFrame:
        joined = df.join(_small(found, sources), "_key")
        expected = F.least(F.lit(float(most)), F.col("c") * (octave * tilt + 1.0))
        # A rest within rounding of a whole number is none.
        joined = joined.withColumn("_e", F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected))
        joined = joined.withColumn("_f", F.col("_e") - F.floor("_e"))
        u = (F.shiftrightunsigned("_draw", 12).cast("double") + 0.5) / float(1 << 52)
        odds = F.when(F.col("_f") > 0, (u / (1 - u)) * (1 - F.col("_f")) / F.when(F.col("_f") > 0, F.col("_f")))
        place = F.least(F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("long"), F.lit((1 << RANK_BITS) - 1))
        return joined.withColumn("_rank", place)

    copied = scratch.table(slim.groupBy("_key", "_draw").agg(F.count("*").alias("_n"), F.max("_size").alias("_size")).where("_n > 1"), "copied")
    copies = copied.count()

    def singles(df: DataFrame) -> DataFrame:
        """Rows without an equal one; all of them where nothing is repeated."""
        return df.join(_small(copied.select("_key", "_draw"), copies), ["_key", "_draw"], "left_anti") if copies else df

    def own_draw(number: str) -> Column:
        return F.xxhash64(F.lit(seed), "_draw", F.col(number).cast("long"))

    drawn = singles(slim).select("_key", "_size", "_draw")
    if copies:
        # Numbers of a large group are listed by many tasks.
        blocks = copied.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES_AT_ONCE}")))).repartition("_key", "_draw", "_block")
        first = F.col("_block") * COPIES_AT_ONCE
        listed = blocks.withColumn("_number", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col("_n")) - 1)))
        drawn = drawn.unionByName(listed.select("_key", "_size", own_draw("_number").alias("_draw")))
    ranks = scratch.table(ranked(drawn, params).where("_f > 0").select("_key", "_size", "_f", "_rank"), "ranks")
    state = scratch.table(
        ranks.groupBy("_key").agg(F.sum(F.col("_f") * F.col("_size")).alias("left")).select("_key", "left", F.lit(0).cast("long").alias("prefix")), "limit0"
    )
    for level in range(1, LEVELS + 1):
        rest = RANK_BITS - LEVEL_BITS * level
        bucket = F.expr(f"shiftright(_rank, {rest})")
        inside = ranks.join(_small(state, sources), "_key").where(F.expr(f"shiftright(_rank, {rest + LEVEL_BITS})") == F.col("prefix"))
        counts = inside.groupBy("_key", bucket.alias("bucket")).agg(F.sum("_size").alias("words"), F.max("left").alias("left"))
        order = Window.partitionBy("_key").orderBy("bucket")
        summed = counts.withColumn("upto", F.sum("words").over(order))
        # The first bucket that reaches the limit, or the last one there is.
        reach = F.when(F.col("upto") >= F.col("left"), F.struct(F.col("bucket").alias("b"), (F.col("upto") - F.col("words")).alias("below"), "words", "left"))
        last = F.struct(F.col("bucket").alias("b"), (F.col("upto") - F.col("words")).alias("below"), "words", "left")
        picked = summed.groupBy("_key").agg(F.coalesce(F.min(reach), F.max(last)).alias("p"))
        state = scratch.table(picked.select("_key", (F.col("p.left") - F.col("p.below")).alias("left"), F.col("p.b").alias("prefix"), F.col("p.words").alias("words")), f"limit{level}")
    # The document at the limit is taken if that comes nearer to it.
    limits = state.select("_key", (F.col("prefix") + F.when(F.col("left") * 2 >= F.col("words"), 1).otherwise(0)).alias("_limit"))
    figures = scratch.table(params.join(limits, "_key", "left"), "figures")
    scratch.drop("sizes", "octaves", "targets", "params", "ranks", *(f"limit{level}" for level in range(LEVELS + 1)))

    every = singles(rows)
    if copies:
        repeated = rows.join(_small(copied.select("_key", "_draw"), copies), ["_key", "_draw"], "left_semi").withColumn("_part", F.spark_partition_id())
        numbered = numbered_copies(scratch.table(repeated, "repeated"), ["_key", "_draw"], "_part", "_number")
        every = every.unionByName(numbered.withColumn("_draw", own_draw("_number")).select(*every.columns))
    taken = ranked(every, figures.withColumnsRenamed({"source_size": "_source_size", "target": "_target"}))
    times = (F.floor("_e") + F.when((F.col("_f") > 0) & (F.col("_rank") < F.col("_limit")), 1).otherwise(0)).cast("int")
    return taken.withColumn("_copies", times).drop("_key", "_draw", "c", "_e", "_f", "_rank", "_limit")
