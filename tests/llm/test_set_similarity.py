"""Groups of near copies against all pairs of their sets of shingles."""

from __future__ import annotations

import random
import time
from pathlib import Path

from samples import DOCS, documents, nothing, odd, texts  # noqa: F401  (fixtures)
from test_operators import shingle_set

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm import set_similarity, simhash_ball
from tidemark.llm.common import Scratch


def groups_of(rows: list[tuple]) -> list[frozenset]:
    """Places of rows that hang together by a similarity of 0.8; texts without words are one group."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j, b in enumerate(sets):
        for k, a in enumerate(sets[:j]):
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                parent[top(j)] = top(k)
    return sorted((frozenset(k for k in range(len(rows)) if top(k) == t) for t in {top(k) for k in parent}), key=min)


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.random()}"
    return out


def near_copies() -> list[tuple]:
    """Pairs about the threshold, one large group of copies that are more and less alike, and a passage that many texts share."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(60):
        base = fresh(rng.choice([40, 150, 400]))
        rows += [base, edited(rng, base, max(1, round(len(base) * (0.018 + k % 4 * 0.003))))]
    base = fresh(150)
    rows += [edited(rng, base, rng.randrange(1, 9)) for _ in range(120)]
    passage = fresh(60)
    rows += [fresh(rng.randrange(5, 60)) + passage + fresh(10) for _ in range(60)]
    rows += [passage[:3], passage[:3], passage[:5], passage[:5] + ["more"], ["again"] * 5, ["again"] * 9]
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def test_groups_equal_all_pairs(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r["root"] for r in set_similarity.similar_texts(docs).collect()}
    got = {}
    for k, root in found.items():
        got.setdefault(root, set()).add(k)
    assert sorted(map(frozenset, got.values()), key=min) == groups_of(rows)


def test_without_rounds_nothing_is_lost(spark, monkeypatch):
    """Nor without a list of what is frequent."""
    monkeypatch.setattr(set_similarity, "ROUNDS", 0)
    monkeypatch.setattr(set_similarity, "LISTED", 1)
    rows = near_copies()
    found = set_similarity.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r["root"] for r in found}) == len(groups_of(rows))


def test_pipeline_keeps_one_of_every_group(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], DOCS)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {min(g) for g in groups_of(rows)}


def test_odd_rows(spark, odd, nothing, documents):
    found = set_similarity.similar_texts(odd, carry=("text",)).collect()
    assert len(found) == odd.count()
    assert len({r["root"] for r in found if not (r["text"] or "").strip()}) == 1
    assert set_similarity.similar_texts(nothing).count() == 0
    rows = texts(documents)
    assert len({r["root"] for r in set_similarity.similar_texts(documents).collect()}) == len(groups_of(rows))


def test_sets_are_compared_where_keys_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(set_similarity, "BROADCAST_BYTES", 0)
    rows = near_copies()
    found = set_similarity.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r["root"] for r in found}) == len(groups_of(rows))


def test_sets_are_made_only_of_long_texts_that_may_be_similar(spark, monkeypatch):
    rng, made, write = random.Random(7), {}, Scratch.table

    def counted(self, df, name):
        out = write(self, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = fresh(300), fresh(1200)
    rows = [fresh(400) + passage + fresh(500) for _ in range(30)] + [base, edited(rng, base, 20)]
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id bigint, text string")
    roots = {r["doc_id"]: r["root"] for r in set_similarity.similar_texts(docs).collect()}
    assert len(set(roots.values())) == 31 and roots[30] == roots[31]
    assert made["sets"] == 2


def test_fine_parities_bound_what_sets_differ_in(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size, other, common in ((1, 1, 0), (5, 9, 5), (60, 70, 40), (64, 66, 64), (700, 900, 650), (3000, 2500, 100), (10, 900, 10)):
        every = rng.integers(0, 1 << 63, size + other - common, dtype=np.uint64)
        a, b = every[:size], every[size - common :]
        rows.append((set_similarity.fine_parities(a).tolist(), set_similarity.fine_parities(b).tolist(), len(set(a.tolist()) ^ set(b.tolist()))))
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, differ int").select(set_similarity._fine_apart("a", "b").alias("apart"), "a", "b", "differ").collect()
    assert all(r["apart"] <= r["differ"] for r in got)
    for r in got[:-1]:
        k = min(len(r["a"]), len(r["b"]))
        fold = lambda x: np.bitwise_xor.reduce(np.array(x, np.int64).reshape(-1, k), 0)  # noqa: B023, E731
        assert r["apart"] == sum(bin(int(v) & (1 << 64) - 1).count("1") for v in fold(r["a"]) ^ fold(r["b"]))
    assert got[5]["apart"] > 2000 and got[6]["apart"] == 0  # the last are of too different sizes to tell


def test_written_tables_free_their_shuffle_files(spark):
    folder, key = Path(spark.conf.get("spark.local.dir", "/tmp")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    before, chosen = files(), spark.conf.get(key)
    df = spark.range(1000).groupBy(F.col("id") % 7).count()
    df.write.format("noop").mode("overwrite").save()
    stay = files() - before
    if not stay:
        pytest.skip("shuffle files of this session are not to be seen")
    Scratch(spark, "test").table(df, "t")
    for _ in range(50):
        if not (left := files() - before - stay):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == chosen


def test_pipeline_links_by_fingerprints_too(spark):
    """Texts that repeat a line so often that their own words hardly count: alike by fingerprints, not by sets, and a set's copy of one of them."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, other = fresh(9), fresh(60)
    a, b = (line * 60 + fresh(20) for _ in range(2))
    rows = [(4, other), (3, a), (9, a + fresh(3)), (2, b), (8, other + fresh(3)), (1, fresh(30))]
    rows = [(k, " ".join(t)) for k, t in rows]
    sets, prints = {k: shingle_set(t) for k, t in rows}, {k: simhash_ball.simhash(t) for k, t in rows}
    assert bin((prints[3] ^ prints[2]) & (1 << 64) - 1).count("1") <= simhash_ball.RADIUS
    assert 5 * len(sets[3] & sets[2]) < 4 * len(sets[3] | sets[2]) and 5 * len(sets[3] & sets[9]) >= 4 * len(sets[3] | sets[9])
    assert 5 * len(sets[4] & sets[8]) >= 4 * len(sets[4] | sets[8])
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], DOCS)
    kept = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == [1, 2, 4]
