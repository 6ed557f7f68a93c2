"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    block_whitening, boosted_quality, kd_shards, merkle_manifest, metric_join, order_minhash, overlap_tokens, pareto_mix,
    prefix_chat, pseudo_likelihood, repeat_spans, simhash_ball, tier_packing,
)
from tidemark.llm.common import table


def vocabulary(name: str, folder: str | None = None) -> str:
    """A tokenizer file: in the given folder, in the one that TIDEMARK_TOKENIZERS names, or of the installed package."""
    folder = folder or os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


def op2_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, folder, "documents"))


def op3_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = pareto_mix.mix_sources(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def op4_simhash_ball(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_ball.near_duplicates(table(spark, folder, "documents"))


def op5_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, folder, "embeddings"))


def op6_repeat_spans(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_spans.repeat_report(table(spark, folder, "documents"))


def op7_overlap_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_tokens.count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_tier_packing(spark: SparkSession, folder: str) -> DataFrame:
    return tier_packing.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op9_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trees = boosted_quality.train(docs, table(spark, folder, "labels"))
    held_out = F.coalesce(boosted_quality.remainder(F.col("doc_id")) == 1, F.lit(False))
    scored = boosted_quality.score(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.shard_documents(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.verified_rows(table(spark, folder, "documents"))


def op12_block_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return block_whitening.whiten(table(spark, folder, "embeddings"))


def op13_prefix_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    saying = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", saying), (-7, 1, "assistant", saying)], "conv_id bigint, turn bigint, role string, text string")
    forest = prefix_chat.merge_turns(rows.union(added), vocabulary=vocabulary("byte_bpe_50k.json"))
    return prefix_chat.read_back(forest).withColumnRenamed("conv", "conv_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_pseudo_likelihood, op2_order_minhash, op3_pareto_mix, op4_simhash_ball, op5_metric_join,
        op6_repeat_spans, op7_overlap_tokens, op8_tier_packing, op9_boosted_quality, op10_kd_shards,
        op11_merkle_manifest, op12_block_whitening, op13_prefix_chat,
    )
}

#: The others draw random numbers, train models, or hash in ways that SQL lacks; their tests hold brute-force versions.
SQL = {
    "op5_metric_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT a AS node, a AS found FROM (SELECT DISTINCT a FROM pairs)
            UNION
            SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.found
        ), least AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node),
        n AS (SELECT a AS node, count(*) AS n_links FROM pairs GROUP BY a)
        SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(least.component_id, v.vec_id) AS component_id,
            v.vec_id = coalesce(least.component_id, v.vec_id) AS kept
        FROM v LEFT JOIN n ON n.node = v.vec_id LEFT JOIN least ON least.node = v.vec_id
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE ids AS (
            -- CRC-32, reflected polynomial 0xEDB88320, over the decimal id
            SELECT DISTINCT doc_id, xor(list_reduce(
                list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
                    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
            ), 4294967295) AS crc FROM documents
        ), fields AS (
            SELECT d.doc_id, d.lang, row_number() OVER () AS row_id, coalesce(crc % 7 = 0, false) AS tampered,
                coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id
        ), leaves AS (
            SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
            FROM fields
        ), trees AS (
            SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY lang
        ), base AS (
            SELECT l.row_id, l.doc_id, l.leaf, l.other, t.tree, t.n,
                row_number() OVER (PARTITION BY t.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS pos
            FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.lang
        ), nodes AS (
            SELECT 0 AS level, tree, pos, n, leaf AS node FROM base
            UNION ALL
            SELECT level + 1, tree, pos // 2, max(n), sha256(string_agg(node, '' ORDER BY pos)) FROM nodes
            WHERE (n - 1) >> level > 0 GROUP BY level, tree, pos // 2
        ), subroots AS (
            SELECT tree, node AS subroot, (SELECT count(*) FROM trees) AS n FROM nodes WHERE (n - 1) >> level = 0
        ), over_nodes AS (
            SELECT 0 AS level, tree AS pos, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, max(n), sha256(string_agg(node, '' ORDER BY pos)) FROM over_nodes
            WHERE (n - 1) >> level > 0 GROUP BY level, pos // 2
        ), siblings AS (
            SELECT b.row_id, n1.level, b.pos >> n1.level AS pos, coalesce(n2.node, '') AS sibling
            FROM base b JOIN nodes n1 ON n1.tree = b.tree AND n1.pos = b.pos >> n1.level AND (b.n - 1) >> n1.level > 0
            LEFT JOIN nodes n2 ON n2.tree = b.tree AND n2.level = n1.level AND n2.pos = xor(n1.pos, 1)
            UNION ALL
            SELECT b.row_id, 1000 + o1.level, b.tree >> o1.level, coalesce(o2.node, '')
            FROM base b JOIN over_nodes o1 ON o1.pos = b.tree >> o1.level AND (o1.n - 1) >> o1.level > 0
            LEFT JOIN over_nodes o2 ON o2.level = o1.level AND o2.pos = xor(o1.pos, 1)
        ), steps AS (
            SELECT row_id, list(struct_pack(pos := pos, sibling := sibling) ORDER BY level) AS steps, string_agg(sibling, '' ORDER BY level) AS proof
            FROM siblings GROUP BY row_id
        ), done AS (
            SELECT b.*, s.subroot, (SELECT node FROM over_nodes WHERE (n - 1) >> level = 0) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                list_reduce(list_prepend(coalesce(other, leaf), list_transform(coalesce(steps, []), lambda x: x.pos % 2 || x.sibling)),
                    lambda node, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || node ELSE node || x[2:] END)) AS folded_root
            FROM base b JOIN subroots s ON s.tree = b.tree LEFT JOIN steps p ON p.row_id = b.row_id
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
    """,
}
