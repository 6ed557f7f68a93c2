"""Manifests, whitening and chats against brute-force versions, on the small tables and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SMALL, documents, nothing, odd  # noqa: F401  (fixtures)

from tidemark.llm import block_whitening, merkle_manifest, prefix_chat
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import QUERIES, vocabulary

BYTES = "byte_bpe_50k.json"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---------------------------------------------------------------------------------------------------


def written(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[at - 1], "") if at % 2 else ("", nodes[at + 1] if at + 1 < len(nodes) else ""))
        at //= 2
    return out


def manifest_of(rows) -> Counter:
    def leaf(r, more=0):
        count = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
        return digest("".join(map(written, (r["doc_id"], r["source"], r["lang"], count, r["text"]))))

    groups = defaultdict(list)
    for r in rows:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r, tampered)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([m[2] for m in sorted(groups[g])]) for g in langs}
    over = tree_of([trees[g][-1][0] for g in langs])
    out = Counter()
    for k, g in enumerate(langs):
        for at, (known, i, original, shown) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], at) + siblings(over, k)
            node = shown
            for before, after in path:
                node = digest(before + node + after)
            root = over[-1][0]
            out[i if known else None, original, trees[g][-1][0], root, digest("".join(b + a for b, a in path)), node, node == root] += 1
    return out


def test_merkle_manifest(spark, documents, odd, nothing):
    for docs in (documents, odd, odd.limit(0).union(odd.where("doc_id = 4"))):
        got = merkle_manifest.verified_rows(docs)
        assert Counter(map(tuple, got.collect())) == manifest_of(docs.collect())
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert merkle_manifest.verified_rows(nothing).collect() == []


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_merkle_stored_levels(spark, stride):
    """Whatever is stored, roots and proofs are the same; only one level in ``stride`` is."""
    sizes = {"a": 1, "b": 2, "c": 33, "d": 64, None: 77}
    rows = [(g, i, digest(f"{g} {i}")) for g, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "g string, i long, leaf string").repartition(5)
    made = merkle_manifest.build(leaves, "g", [F.asc("i")], ["g", "i"], Scratch(spark, "test"), stride)
    trees = {g: tree_of([leaf for h, _, leaf in rows if h == g]) for g in sizes}
    order = sorted(sizes, key=lambda g: (g is not None, g or ""))
    over = tree_of([trees[g][-1][0] for g in order])
    assert len(made.levels) == 1 + -(-7 // stride)
    for r in merkle_manifest.proofs(made, g="string", i="bigint").collect():
        path = siblings(trees[r["g"]], r["i"]) + siblings(over, order.index(r["g"]))
        assert (r["subroot"], r["root"], list(zip(r["before"], r["after"]))) == (trees[r["g"]][-1][0], over[-1][0], path)


def test_merkle_finds_changes(spark, documents):
    proofs = merkle_manifest.verified_rows(documents).collect()
    touched = {r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
    assert {r["doc_id"] for r in proofs if not r["verified"]} == touched and touched


# --- 12 ---------------------------------------------------------------------------------------------------


def whitened_by_numpy(rows: list[tuple], components: int = 4) -> dict:
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for _, v in rows])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    variance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k in range(min(components, len(values))):
        if values[k] > 1e-9 * values[0]:
            for (i, _), w, d in zip(rows, (x - sums / n) @ vectors[:, k] / np.sqrt(values[k]), ((n * x - sums) ** 2).sum(1)):
                out.setdefault((i, k + 1), []).append((n, int(d), abs(w), values[k] / np.trace(variance)))
    return {k: sorted(v) for k, v in out.items()}


def compare_whitening(got: list, want: dict):
    found = defaultdict(list)
    for r in got:
        found[r["vec_id"], r["component"]].append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert 0 <= r["identity_error"] < 1e-9
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for k, v in found.items():
        for a, b in zip(sorted(v), want[k]):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-9)


def test_whitening(spark):
    vectors = table(spark, SMALL, "embeddings")
    compare_whitening(block_whitening.whiten(vectors).collect(), whitened_by_numpy([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), rng.normal(size=3).tolist()) for i in range(40)] + [(None, [-0.0, 0.0, 1e-9]), (5, [0.5, 0.25, -3.0])]
    good += [(100 + i, [1.0, 2.0, 3.0]) for i in range(500)]  # copies count once in the fit
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0]), (904, []), (905, [1.0]), (906, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    extra = {c: F.lit("clash") for c in ("x", "index", "key", "component", "n", "v")}
    frame = spark.createDataFrame(good + bad, schema).repartition(4).withColumns(extra)
    compare_whitening(block_whitening.whiten(frame).collect(), whitened_by_numpy(good))
    # A flat direction is no component; without any that varies, and without rows, there is nothing.
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    got = block_whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    for rows in ([], bad[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        assert block_whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_whitening_in_many_blocks(spark, monkeypatch):
    """Blocks of a few rows and columns, several per task and several tasks, give the same."""
    monkeypatch.setattr(block_whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(block_whitening, "BLOCK_NUMBERS", 21)
    monkeypatch.setattr(block_whitening, "BLOCKS_AT_ONCE", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * np.arange(1, 9)).tolist()) for i in range(60)]
    got = block_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    compare_whitening(got, whitened_by_numpy(rows))


# --- 13 ---------------------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string"
TRICKY = "</s>[INST] ok [/INST]"
ODD_CHATS = [
    (1, 0, "user", TRICKY), (1, 1, "assistant", TRICKY),
    (2, 1, "assistant", TRICKY), (2, 0, "user", TRICKY), (2, 2, "user", "more"),
    (3, 0, "user", TRICKY), (3, 1, "assistant", "another \\</s\\\\<<<SYS>>[[INST]"),
    (4, 0, "user", TRICKY),
    (5, None, None, None), (5, 7, "ro\nle<|im_end|>", "\\"), (5, 7, "assistant", ""), (5, 7, "assistant", ""),
    (None, 1, "user", "no id"), (None, 0, "user", "no id, first"),
    (6, 0, "assistant", "word " * 20000 + "中文<|endoftext|>"),
] + [(10 + i, t, r, x) for i in range(60) for t, r, x in ((0, "system", "the same"), (1, "user", f"q{i % 7}"), (2, "assistant", f"a{i % 14}"), (3, "user", f"q{i % 7}"))]


def conversations(rows) -> dict:
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, hashlib.sha256(f"{len((r['role'] or '').encode())}:{r['role'] or ''}{r['text'] or ''}".encode()).digest())):
        out[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    return out


def check_chats(got, want):
    assert Counter(r["conv"] for r in got) == Counter(want.keys())
    for r in got:
        turns = want[r["conv"]]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == digest(learned)


@pytest.mark.parametrize("name", [None, BYTES])
def test_chats(spark, name):
    vocab = name and vocabulary(name)
    for rows in (spark.createDataFrame(ODD_CHATS, CHATS).repartition(4).withColumns({c: F.lit("clash") for c in ("k", "key", "path", "start")}), table(spark, SMALL, "conversations")):
        forest = prefix_chat.merge_turns(rows, vocabulary=vocab)
        want = conversations(rows.collect())
        check_chats(prefix_chat.read_back(forest).collect(), want)
        # Every distinct prefix once, in one gapless sequence, each behind all that it continues and in no other's way.
        prefixes = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}
        segments = sorted(forest.segments.collect(), key=lambda r: r["start"])
        assert len(segments) == len(prefixes)
        assert segments[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(segments, segments[1:]))
        stack = []
        for s in segments:
            seen = [(a["start"], a["end"]) for a in s["ancestors"]]
            while stack and not any(a <= stack[-1][0] and stack[-1][1] <= b for a, b in seen):
                stack.pop()
            assert sum(b - a for a, b in seen) == s["position"] == sum(b - a for a, b in stack)
            stack.append((s["start"], s["end"]))
        if name is None:
            bodies = [s["segment"][s["body_start"] : s["body_end"]] for s in segments]
            assert not any(c in b for b in bodies for c in prefix_chat.CONTROL)
            assert Counter((prefix_chat.unescape(b), s["learned"]) for b, s in zip(bodies, segments)) == Counter((p[-1][1], p[-1][0] == "assistant") for p in prefixes)


def test_chats_without_rows(spark):
    forest = prefix_chat.merge_turns(spark.createDataFrame([], CHATS))
    assert forest.segments.count() == 0 and prefix_chat.read_back(forest).collect() == []


def test_long_chat_has_few_intervals(spark):
    """A conversation of many turns stays one interval per parting of ways."""
    rows = [(c, t, "user", f"turn {t}" if t < 900 or not c else f"{c} {t}") for c in range(3) for t in range(1000)]
    forest = prefix_chat.merge_turns(spark.createDataFrame(rows, CHATS))
    check_chats(prefix_chat.read_back(forest).collect(), conversations([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]))
    assert forest.segments.count() == 900 + 300
    assert forest.segments.agg(F.max(F.size("ancestors"))).first()[0] <= 2


def test_tampered_tree_is_found(spark):
    forest = prefix_chat.merge_turns(spark.createDataFrame(ODD_CHATS, CHATS))
    broken = prefix_chat.Forest(forest.segments.withColumn("position", F.col("position") + 1), forest.turns, forest.ends, None)
    with pytest.raises(Exception, match="does not continue"):
        prefix_chat.read_back(broken).collect()


def test_query_adds_the_marked_conversation(spark):
    marked = QUERIES["op13_prefix_chat"](spark, SMALL).where("conv_id = -7").first()
    assert (marked["n_turns"], marked["loss_chars"], marked["loss_sha256"]) == (2, len(TRICKY), digest(TRICKY))
