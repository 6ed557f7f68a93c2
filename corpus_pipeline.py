"""From raw documents to packed sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import boosted_quality, pareto_mix, repeat_spans, set_similarity, simhash_ball, tier_packing
from tidemark.llm.common import Scratch, components, computed, table, whole
from tidemark.llm.queries import vocabulary

#: Documents scored below this are rejected.
LEAST_SCORE = 0.5
#: Jaccard similarity of the sets of five-word shingles of two documents that count as near copies.
LEAST_SIMILARITY = 0.8
#: Bytes of a passage that is dropped wherever it repeats: some 50 words.
REPEAT_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores low; the others stay as they are."""
    trees = boosted_quality.train(docs, table(spark, sf_dir, "labels"))
    return boosted_quality.score(docs, trees, score_col="_score").where(F.col("_score") >= LEAST_SCORE).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of the least id, null last, and then the least digest.

    A group hangs together by links of both kinds: SimHash fingerprints that differ in two bits at most, and sets of shingles of ``LEAST_SIMILARITY``.
    """
    marked, scratch = docs.withColumn("_digest", F.md5(whole("text").cast("binary"))), Scratch(spark, "keepers")
    prints = simhash_ball.near_duplicates(marked, carry=("_digest",), root_col="_print")
    prints = scratch.table(prints.select("_digest", "_print").distinct(), "prints")
    found = set_similarity.similar_texts(marked, carry=("_digest",), root_col="_root", similarity=LEAST_SIMILARITY)
    counted = scratch.table(found.groupBy("_root", "doc_id", "_digest").agg(F.count("*").alias("_n")), "counted")
    # Groups of sets that one group of fingerprints joins: each is linked to the least of them.
    joined = scratch.table(counted.select("_digest", "_root").distinct().join(prints, "_digest").select("_print", "_root").distinct(), "joined")
    least = joined.groupBy("_print").agg(F.min("_root").alias("a"), F.max("_root").alias("_most")).where("a < _most").select("_print", "a")
    links = joined.join(least, "_print").where(F.col("_root") > F.col("a")).select("a", F.col("_root").alias("b"))
    groups = components(links, scratch).select(F.col("node").alias("_root"), F.col("root").alias("_group"))
    grouped = counted.join(groups, "_root", "left").withColumn("_group", F.coalesce("_group", "_root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_digest", "_n")).alias("_least")
    keepers = scratch.table(grouped.groupBy("_group").agg(least).select("_least.doc_id", "_least._digest", "_least._n"), "keepers")
    scratch.drop("prints", "counted", "joined", "parents")
    same = marked["doc_id"].eqNullSafe(keepers["doc_id"]) & (marked["_digest"] == keepers["_digest"])
    kept = marked.join(keepers, same, "left_semi")
    if not keepers.where("_n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_digest"])  # rows that repeat one id and text
    return kept.drop("_digest")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that start at more than one place; a character cut in two is dropped whole."""
    marked = repeat_spans.drop_repeats(docs, length=REPEAT_BYTES)
    touched = F.size("_runs") > 0

    def cut(texts, runs):
        return [[repeat_spans.kept_bytes((t or "").encode("utf-8", "surrogatepass"), r).decode("utf-8", "ignore") for t, r in zip(texts, runs)]]

    clean = marked.where(~touched).select(*docs.columns)
    shorter = computed(marked.where(touched).withColumnRenamed("text", "_text"), ["_text", "_runs"], "text string", cut)
    shorter = shorter.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.unionByName(shorter.select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = pareto_mix.mix_sources(docs)
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return tier_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("packing", packing)]

#: Training, fingerprints and packing are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
