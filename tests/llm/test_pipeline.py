"""The pipeline's stages against plain versions of what they promise."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from samples import DOCS, PROSE, SMALL, documents, nothing, odd, texts  # noqa: F401  (fixtures)
from test_operators import check_packing, shingle_set, slow_repeats

import corpus_pipeline as pipeline
from tidemark.llm.common import Scratch, table


@pytest.fixture(scope="module")
def staged(spark):
    scratch, docs, out = Scratch(spark, "test"), table(spark, SMALL, "documents"), []
    for name, stage in pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def test_names_and_columns(spark, staged):
    columns = table(spark, SMALL, "documents").dtypes
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixture", "packing"]
    assert all(df.dtypes == columns for df in staged[:-1])


def test_quality_keeps_good_documents(spark, staged):
    kept = {r["doc_id"] for r in staged[0].collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.97
    assert Counter(staged[0].collect()) <= Counter(table(spark, SMALL, "documents").collect())


def test_one_document_of_each_group(spark, staged):
    """No two documents of a 5-word similarity of 0.9 stay, and whatever goes is near one of a lower id that was there."""
    rows, kept = dict(texts(staged[0])), {r["doc_id"] for r in staged[1].collect()}
    sets = {i: shingle_set(t) for i, t in rows.items()}
    stay = sorted(kept)
    for k, a in enumerate(stay):
        assert not any(len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) for b in stay[k + 1 :])
    for a in rows.keys() - kept:
        assert max(len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for b in rows if b != a) > 0.5
    assert kept < rows.keys()


def test_repeats_are_cut(spark, staged):
    want = Counter((r[0], r[4]) for r in slow_repeats(texts(staged[1]), pipeline.REPEAT_BYTES).elements())
    got = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(staged[2]))
    assert sum((got & want).values()) >= 0.98 * sum(want.values())  # the rest ends inside a character
    assert all(r["n_chars"] == len(r["text"]) for r in staged[2].collect())


def test_mixture_repeats_rows(spark, staged):
    before, after = Counter(staged[2].collect()), Counter(staged[3].collect())
    assert set(after) <= set(before) and all(after[r] <= 3 * before[r] for r in after)


def test_packing_holds_everything(spark, staged):
    from tidemark.llm.common import tokenizer
    from tidemark.llm.queries import vocabulary

    library = tokenizer(vocabulary("word_bpe_49k.json"))
    want = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(staged[3]))
    assert sum(r["length"] for r in staged[4].collect()) == want
    check_packing(staged[1].limit(40))


def test_stages_take_odd_rows(spark, odd, nothing):
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0, name
        stage(spark, odd, SMALL).collect()
    rows = [(None, PROSE, "en", "a", 1), (None, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1), (5, "quite another text of a few words", "en", "a", 1)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 5]


def test_run_equals_its_stages(spark, staged):
    key = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert sum(r["length"] for r in pipeline.run(spark, SMALL).collect()) == sum(r["length"] for r in staged[-1].collect())
    assert key(staged[-1])


def test_groups_without_or_under_one_id_keep_a_document_each(spark):
    other = [" ".join(f"{word}{k * j % 97}" for k in range(80)) for j, word in enumerate(("oak", "elm", "ash", "fir", "yew"), 1)]
    rows = [(None, t, "en", "a", 1) for t in other[:3] * 2] + [(7, other[3], "en", "a", 1), (7, other[4], "en", "a", 1), (7, other[4], "en", "a", 1), (7, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(None, t) for t in other[:3]] + [(7, other[3]), (7, other[4]), (2, PROSE)])
