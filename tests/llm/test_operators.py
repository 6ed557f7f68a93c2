"""Each operator against a brute-force version, on the small tables and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import SMALL, documents, nothing, odd, texts  # noqa: F401  (fixtures)

from tidemark.llm import boosted_quality, kd_shards, metric_join, order_minhash, overlap_tokens, pareto_mix, pseudo_likelihood, repeat_spans, simhash_ball, tier_packing
from tidemark.llm.common import Scratch, components, table, tokenizer
from tidemark.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def unite(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- connected components ---------------------------------------------------------------------------------


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(k + 1, k) for k in range(60)], [(0, k) for k in range(1, 50)] + [(99, 50), (50, 49)], [(5, 5), (None, 3), (9, 7), (7, 8)]])
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "test")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == unite(real, {n for p in real for n in p})


# --- 1 ----------------------------------------------------------------------------------------------------


def test_pseudo_likelihood_learns(spark, documents):
    part = documents.where("doc_id % 4 <> 0")
    words, network = pseudo_likelihood.train(part)
    blank = pseudo_likelihood.Network.fresh(np.ones(pseudo_likelihood.CLASSES * pseudo_likelihood.MEMBERS))
    held = documents.where("doc_id % 4 = 0")
    def mean(model):
        rows = pseudo_likelihood.score(held, model).collect()
        return sum(r["log_likelihood"] for r in rows) / sum(r["n_tokens"] for r in rows)

    assert mean((words, network)) > mean((words, blank)) + 0.5
    # Order matters to a model that looks at neighbours: shuffled words are less likely.
    rng = np.random.default_rng(1)
    mixed = spark.createDataFrame([(i, " ".join(rng.permutation((t or "").split()).tolist())) for i, t in texts(held)], "doc_id long, text string")
    assert np.mean([r["log_likelihood"] for r in pseudo_likelihood.score(mixed, (words, network)).collect()]) < np.mean(
        [r["log_likelihood"] for r in pseudo_likelihood.score(held, (words, network)).collect()]
    )


def test_pseudo_likelihood_is_a_distribution_and_its_sum(spark, odd, nothing):
    words, network = pseudo_likelihood.train(odd)
    near = np.array([[3, 70, 5000 % pseudo_likelihood.EDGE, pseudo_likelihood.EDGE]])
    every = np.arange(pseudo_likelihood.CLASSES * pseudo_likelihood.MEMBERS)
    assert np.exp(network.log_probability(np.repeat(near, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    got = Counter()
    for r in pseudo_likelihood.score(odd, (words, network)).collect():
        got[r["doc_id"], r["n_tokens"], round(r["log_likelihood"], 2)] += 1
    want = Counter()
    for i, t in texts(odd):
        tokens, total = words.tokens(t), 0.0
        for k in range(len(tokens)):
            total += network.log_probability(pseudo_likelihood.neighbours(tokens, np.array([k])), tokens[k : k + 1])[0]
        want[i, len(tokens), round(total, 2)] += 1
    assert sum((abs(a[2] - b[2]) < 0.1 and a[:2] == b[:2]) for a, b in zip(sorted(got, key=str), sorted(want, key=str))) == len(want)
    assert pseudo_likelihood.train(nothing) is None
    assert pseudo_likelihood.score(nothing, None).count() == 0
    assert pseudo_likelihood.score(odd, None).count() == odd.count()


def test_pseudo_likelihood_parts_the_buckets(spark, documents):
    """Words outside the vocabulary get their share of a bucket: invented ones, counted or not, score below ordinary texts."""
    rng = np.random.default_rng(2)
    invented = " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(300))
    gibberish = spark.createDataFrame([(-1, invented)], "doc_id long, text string")
    docs = documents.select("doc_id", "text")
    for seen in (docs.union(gibberish), docs):
        words, network = pseudo_likelihood.train(seen)
        means = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudo_likelihood.score(docs.union(gibberish), (words, network)).collect()}
        assert means[-1] < np.median([m for i, m in means.items() if i >= 0 and m is not None]) - 3
        shares, spelled = np.zeros(pseudo_likelihood.MEMBERS), 0.0
        for r in words.shares.collect():
            shares[zlib.crc32(r["word"]) % pseudo_likelihood.MEMBERS] += np.exp(r["share"])
        assert shares + words.left == pytest.approx(1)
        every = {w for _, t in texts(seen) for w in pseudo_likelihood.words_of(t)}
        assert {bytes(r["word"]) for r in words.shares.collect()} == every - set(words) and every > set(words)
        for w in every:
            spelled += np.exp(sum(words.spelling[a, b] for a, b in zip(b" " + w, w + b" ")))
        assert words.unseen == pytest.approx(np.log(1 - spelled))


def test_pseudo_likelihood_held_shares_equal_joined_ones(spark, documents, monkeypatch):
    """It makes no difference which words outside the workers hold and which are joined."""
    monkeypatch.setattr(pseudo_likelihood, "NEAR", 300)
    docs = documents.select("doc_id", "text")
    words, network = pseudo_likelihood.train(docs, epochs=1)
    every = {bytes(r["word"]): r["share"] for r in words.shares.collect()}
    rare = {bytes(r["word"]) for r in words.rare.collect()}
    assert rare < set(every) and 0 < len(every) - len(rare) <= 300 and not rare & set(words.places)
    got = {r["doc_id"]: r["log_likelihood"] for r in pseudo_likelihood.score(docs, (words, network)).collect()}
    words.hold(list(every), list(every.values()))
    words.rare = words.shares.where("false")
    assert got == pytest.approx({r["doc_id"]: r["log_likelihood"] for r in pseudo_likelihood.score(docs, (words, network)).collect()})


# --- 2 ----------------------------------------------------------------------------------------------------


def edited_texts(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        out[i] = (t, t[: len(t) - k] + after[:k], after)
    return out


def test_order_minhash(spark, documents):
    rows = order_minhash.fingerprint_edits(documents).collect()
    want = edited_texts(texts(documents))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, (t, e, _) in want.items()}
    by_text = defaultdict(set)
    for r in rows:
        by_text[want[r["doc_id"]][0]].add(r["fingerprint"])
        by_text[want[r["doc_id"]][1]].add(r["edited_fingerprint"])
        places = [r[c][k : k + 8] for c in ("fingerprint", "edited_fingerprint") for k in range(0, 512, 8)]
        assert r["near_edited"] == sum(a == b for a, b in zip(places[:64], places[64:])) / 64
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in rows]) > 0.15 > 0.02 > np.mean([r["near_next"] for r in rows])


def test_order_minhash_signature_by_brute_force(spark):
    """Numbered grams, one sort per sketch, text order: in Python with the same hash function."""
    cases = ["", " ", "a", "a b", "a b c", "a b c a b c a b c a b c x", "to be or not to be that is the question " * 4, "z " * 50, "w" * 40 + " tail of it"]
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", order_minhash.signature("t").alias("s")).collect()}

    def hashes(values):  # Spark's own function, the only part that is shared
        return [r["h"] for r in values]

    for case in cases:
        words = re.findall(order_minhash.PIECE, case)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)] or ([tuple(words)] if words else [])
        seen, numbered = Counter(), []
        for g in grams:
            numbered.append((list(g), seen[g]))
            seen[g] += 1
        if not numbered:
            assert set(got[case]) == {-(1 << 31)}
            continue
        keys = hashes(
            spark.createDataFrame([(k, g, n) for k, (g, n) in enumerate(numbered)], "k int, g array<string>, n int").selectExpr("k", "xxhash64(xxhash64(g), n) AS h").orderBy("k").collect()
        )
        tuples = []
        for j in range(64):
            mark = -(1 << 63) + j * (1 << 58)
            first = sorted(range(len(keys)), key=lambda p: (keys[p] - mark) % (1 << 64))
            chosen = [first[k % len(first)] for k in range(2)]
            tuples.append([keys[p] for p in sorted(chosen)])
        want = hashes(spark.createDataFrame([(j, t) for j, t in enumerate(tuples)], "j int, t array<long>").selectExpr("j", "CAST((xxhash64(t) & 4294967295) - 2147483648 AS INT) AS h").orderBy("j").collect())
        assert got[case] == want, case


def test_order_minhash_sees_order(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " + " ".join(f"w{k}" for k in range(200))
    halves = a.split()
    moved = " ".join(halves[110:] + halves[:110])
    r = spark.createDataFrame([(a, moved)], "a string, b string").select(order_minhash.signature("a").alias("x"), order_minhash.signature("b").alias("y"))
    near = r.select(order_minhash.likeness("x", "y").alias("n"), order_minhash.likeness("x", "x").alias("same")).first()
    assert near["same"] == 1 and 0.2 < near["n"] < 0.8  # the grams are nearly all the same, their order is not


def test_order_minhash_of_unspaced_text(spark):
    """One character more at the front or inside leaves most places alike, beyond the basic plane too."""
    rng = np.random.default_rng(3)
    for first, n in ((0x4E00, 5000), (0x20000, 5000), (ord("a"), 26)):
        text = "".join(map(chr, first + rng.integers(0, n, 1200)))
        rows = [(text, x + text[:600] + y + text[600:]) for x, y in (("", ""), (text[5], ""), ("", text[5]), (text[5], text[7]))]
        near = spark.createDataFrame(rows, "a string, b string").select(order_minhash.signature("a").alias("x"), order_minhash.signature("b").alias("y"))
        got = [r["n"] for r in near.select(order_minhash.likeness("x", "y").alias("n")).collect()]
        assert got[0] == 1 and min(got) > 0.8


def test_order_minhash_odd(spark, odd, nothing):
    rows = order_minhash.fingerprint_edits(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert order_minhash.fingerprint_edits(nothing).count() == 0
    assert order_minhash.fingerprint_edits(odd.where("doc_id IS NULL")).count() == 2
    one = order_minhash.fingerprint_edits(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("ids", [range(3000), [7] * 5 + [1, 9, None, None], [k**3 for k in range(2000)], [None] * 3, [4]])
def test_with_next(spark, ids):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "i long, t long")
    got = {r["t"]: r["next_t"] for r in order_minhash.with_next(df, "i", "t", "t").collect()}
    order = [k for k, i in sorted(enumerate(ids), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert got == dict(zip(order, order[1:] + order[:1]))


# --- 3 ----------------------------------------------------------------------------------------------------


def shares(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def test_pareto_mix(spark, documents):
    frame = pareto_mix.mix_sources(documents)
    rows = frame.collect()
    sizes = Counter()
    for r in rows:
        assert r["_size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["_size"]
    want, largest, taken = shares(sizes), Counter(), Counter()
    for r in rows:
        assert r["_target"] == pytest.approx(want[r["source"]]) and r["_source_size"] == sizes[r["source"]] and 0 <= r["_copies"] <= 3
        largest[r["source"]] = max(largest[r["source"]], r["_size"])
        taken[r["source"]] += r["_copies"] * r["_size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = {(r["doc_id"]): r["_copies"] for r in pareto_mix.mix_sources(documents.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["_copies"] for r in rows}


def test_pareto_mix_caps(spark):
    rows = [(k, "w " * (k % 7 + 1), s) for k, s in enumerate(["a"] * 3 + ["b"] * 400 + ["c"] * 20 + [None] * 5 + ["d"] * 2)]
    got = pareto_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = shares(sizes), Counter()
    for r in got:
        assert r["_target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["_copies"] * r["_size"]
        if want[r["source"]] == 3 * sizes[r["source"]]:
            assert r["_copies"] == 3
    assert any(want[s] == 3 * sizes[s] for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)


def test_pareto_inclusion_follows_the_preference(spark):
    """Over many seeds each length class is taken as often as its expected copies say."""
    rows = [(k, "w " * (1 if k % 2 else 31), "a" if k < 200 else "b") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    seen = defaultdict(list)
    for seed in range(4):
        for r in pareto_mix.mix_sources(df, weights=(1, 2), tilt=0.3, seed=seed).where("source = 'a'").collect():
            seen[r["_size"]].append(r["_copies"])
    short, long = np.mean(seen[1]), np.mean(seen[31])
    # Preferences 1 + 0.3 * 1 and 1 + 0.3 * 5; half of source a's words are wanted twice over three.
    assert long > short and long / short == pytest.approx(2.5 / 1.3, rel=0.25)


@pytest.mark.parametrize("ids", [1, 0])
def test_pareto_mix_of_repeated_rows(spark, monkeypatch, ids):
    """Thousands of equal rows, with an id or a null one: each has its own draw, and the source comes within a document of its target."""
    monkeypatch.setattr(pareto_mix, "COPIES_AT_ONCE", 300)
    same = "a text of five words"
    rows = [(7 if ids else None, same, "a")] * 1000 + [(k, same, "b") for k in range(1000)] + [(3, "two words", "b")] * 500 + [(None, None, "c")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = [pareto_mix.mix_sources(df, weights=(1, 3, 1), most=2).collect() for _ in range(2)]
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1])) and len(got[0]) == len(rows)
    for source, largest in (("a", 5), ("b", 5)):
        mine = [r for r in got[0] if r["source"] == source]
        assert abs(sum(r["_size"] * r["_copies"] for r in mine) - mine[0]["_target"]) <= largest
        assert 0 <= min(r["_copies"] for r in mine) <= max(r["_copies"] for r in mine) <= 2
    assert len({r["_copies"] for r in got[0] if r["source"] == "a"}) == 2


def test_pareto_mix_odd(spark, odd, nothing):
    got = pareto_mix.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r["id"] == "clash" for r in got)
    assert pareto_mix.mix_sources(nothing).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------


def slow_simhash(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(df):
    rows = df.select("doc_id", "text").collect()
    prints = [(r["doc_id"], slow_simhash(r["text"] or "")) for r in rows]
    values = sorted({p for _, p in prints})
    links = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    group, least = unite(links, values), {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = Counter((i, f"{p:016x}", least.get(group[p])) for i, p in prints)
    assert Counter(map(tuple, simhash_ball.near_duplicates(df).collect())) == want


def test_simhash(spark, documents, odd, nothing):
    check_simhash(documents)
    check_simhash(odd)
    assert simhash_ball.near_duplicates(nothing).count() == 0


def test_simhash_finds_chains(spark, monkeypatch):
    """Fingerprints in a chain of two-bit steps, and stars around a value that no document has."""
    base = 0x0123456789ABCDEF
    prints = [base]
    for k in range(0, 40, 2):
        prints.append(prints[-1] ^ (3 << k))
    prints += [0xF0F0F0F0F0F0F0F0 ^ (1 << b) for b in range(64)]
    rows = [(k, str(p)) for k, p in enumerate(prints)]
    monkeypatch.setattr(simhash_ball, "simhash", lambda text: int(np.uint64(int(text)).astype(np.int64)))
    got = {r["doc_id"]: r["component_id"] for r in simhash_ball.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(len(prints))}


def shingle_set(text: str) -> set[bytes]:
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def check_similar(rows: list[tuple], group: dict) -> None:
    """Texts of a similarity of 0.9 share a group; what shares one hangs together by pairs that the bits allow."""
    most, sets = simhash_ball.most_bits(0.8, 256), {i: shingle_set(t) for i, t in rows}
    bits = {i: sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(simhash_ball.wide_simhash(t))) for i, t in rows}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (bits[a] ^ bits[b]).bit_count() <= most]
    linked = unite(near, ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]):
                assert group[a] == group[b], (a, b)
            assert group[a] != group[b] or linked[a] == linked[b], (a, b)


@pytest.mark.parametrize("tasks", [1, 50])
def test_similar_documents(spark, tasks):
    """A group of near copies that many tasks share, chains of edits, texts of few words, nulls and blank ones."""
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    base, rows = draw(400), []
    for _ in range(60):
        said = list(base)
        said[rng.integers(0, 400)] = "other"
        rows.append(" ".join(said))
    rows += [" ".join(draw(int(n))) for n in rng.integers(1, 200, 40)]
    step = draw(300)
    for k in range(12):  # each is like the one before, the last is not like the first
        step[k * 25] = step[k * 25 + 1] = "new"
        rows.append(" ".join(step))
    rows += ["", " \t ", "one", "ONE", "three words here"]
    rows = list(enumerate(rows))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame([*rows, (None, None), (3, rows[3][1])], "doc_id long, text string")
        found = simhash_ball.similar_documents(docs, carry=("text",)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    group = {r["doc_id"]: r["root"] for r in found}
    assert Counter(r["doc_id"] for r in found) == Counter([None, 3, *dict(rows)])
    assert group[None] == group[112] == group[113] and group[114] == group[115] != group[116]
    assert len({group[k] for k in range(60)}) == 1 and len({group[k] for k in range(60, 100)}) == 40
    check_similar(rows, group)


def test_similar_documents_odd(spark, documents, odd, nothing):
    found = simhash_ball.similar_documents(documents).collect()
    check_similar(texts(documents), {r["doc_id"]: r["root"] for r in found})
    assert len(found) == documents.count()
    assert simhash_ball.similar_documents(odd).count() == odd.count()
    assert simhash_ball.similar_documents(nothing).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------------


def slow_links(rows, threshold=0.93):
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, np.float64), label))
    links, count = [], Counter()
    for k, (a, x, la) in enumerate(good):
        for b, y, lb in good[k + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    return unite(links, {r[0] for r in rows}), count


def check_vectors(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    root, count = slow_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_vectors(df).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i, _, _ in rows}


def clusters(n=900, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    return [(k, (centres[k % 25] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist(), k % 2) for k in range(n)]


def test_vectors_in_many_cells(spark, monkeypatch):
    for name, value in (("CELL", 20), ("PART", 16)):
        monkeypatch.setattr(metric_join, name, value)
    rows = clusters()
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(40)] + [(2000 + k, [2 * x for x in rows[3][1]], rows[3][2]) for k in range(3)]
    check_vectors(spark, rows)


def test_vectors_of_one_dense_cell(spark, monkeypatch):
    """No group that one task joins holds more than a part and a block, however many vectors sit in one place."""
    for name, value in (("CELL", 50), ("PART", 20), ("AGAINST", 30)):
        monkeypatch.setattr(metric_join, name, value)
    real, most = metric_join.deal, []

    def watched(copied, grid):
        dealt = real(copied, grid)
        groups = dealt.groupBy("label", "d", "cell", "part", "block").agg(F.count_if("home").alias("home"), F.count_if("other").alias("other"))
        most.append(groups.agg(F.max("home"), F.max("other"), F.count("*")).first())
        return dealt

    monkeypatch.setattr(metric_join, "deal", watched)
    rng = np.random.default_rng(2)
    dense = [(k, (np.ones(8) + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), 0) for k in range(300)]
    check_vectors(spark, dense + [(1000 + i, v, label) for i, v, label in clusters(200)] + [(2000, dense[7][1], 0), (2001, dense[7][1], 0)])
    home, other, groups = most[0]
    assert home <= 2 * metric_join.PART and other <= 3 * metric_join.AGAINST and groups > 20


def test_pivots_are_shared_by_size():
    few = metric_join.pivot_counts([10_000, 2_500, 2_000], [64] * 3)
    assert few == [9, 2, 0]
    many = metric_join.pivot_counts([1_000_000] * 50, [64] * 50)
    assert min(many) == max(many) > metric_join.ALL_PIVOTS // 50 * 0.8 and sum(many) <= metric_join.ALL_PIVOTS
    uneven = metric_join.pivot_counts([10**9] + [100_000] * 60, [64] * 61)
    assert uneven[0] == metric_join.LABEL_PIVOTS and min(uneven) > 90 and sum(uneven) <= metric_join.ALL_PIVOTS
    wide = metric_join.pivot_counts([1_000_000] * 50, [16_384] * 50)
    assert sum(wide) * 16_384 * 8 <= metric_join.PIVOT_BYTES and min(wide) > 1


def test_many_large_labels_all_get_pivots(spark, monkeypatch):
    for name, value in {"CELL": 8, "ALL_PIVOTS": 160, "LABEL_PIVOTS": 16}.items():
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 20, 6))
    rows = [(1000 * label + 40 * k + n, label, (base[label, k] + 0.1 * rng.normal(size=6)).tolist()) for label in range(50) for k in range(20) for n in range(3)]
    asked, made = [], metric_join.Cells.__init__

    def watched(self, pivots, radius):
        asked.append({g: len(p) for g, p in pivots.items()})
        made(self, pivots, radius)

    monkeypatch.setattr(metric_join.Cells, "__init__", watched)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(7)
    got = {r["vec_id"]: r["n_links"] for r in metric_join.near_vectors(df).collect()}
    assert len(asked[0]) == 50 and sum(asked[0].values()) <= 160
    for label in range(50):
        mine = [(i, np.array(v)) for i, at, v in rows if at == label]
        x = np.array([v / np.linalg.norm(v) for _, v in mine])
        near = (x @ x.T >= metric_join.THRESHOLD).sum(1) - 1
        assert [got[i] for i, _ in mine] == near.tolist()


def test_vectors_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [0.0, 0.0, 0.0], 0), (3, [1.0, None, 1.0], 0), (4, [float("nan"), 1.0, 1.0], 0), (5, [float("inf"), 1.0, 1.0], 0), (6, v, None), (7, v, None), (8, v, 0), (9, v, 0), (10, v, 1), (11, [1.0, 2.0], 0), (12, [], 0), (13, [2.0, 4.0, 6.0], 0), (14, [1e-30, 2e-30, 3e-30], 0), (15, [1e30, 2e30, 3e30], 0)]
    check_vectors(spark, rows)
    assert metric_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_the_table(spark):
    check_vectors(spark, [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding", "label").collect()])


# --- 6 ----------------------------------------------------------------------------------------------------


def slow_repeats(rows, length):
    where = defaultdict(list)
    raws = [(i, (t or "").encode()) for i, t in rows]
    for d, (_, raw) in enumerate(raws):
        for k in range(len(raw) - length + 1):
            where[raw[k : k + length]].append((d, k))
    marked = [np.zeros(len(raw), bool) for _, raw in raws]
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                marked[d][k : k + length] = True
    out = Counter()
    for (i, raw), gone in zip(raws, marked):
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")] += 1
    return out


def check_repeats(df, length):
    got = Counter(map(tuple, repeat_spans.repeat_report(df, length=length).collect()))
    assert got == slow_repeats(texts(df), length)


@pytest.mark.parametrize("length", [400, 40, 57])
def test_repeats(spark, documents, length):
    check_repeats(documents, length)


@pytest.mark.parametrize("length", [400, 33])
def test_repeats_odd(spark, odd, nothing, length):
    check_repeats(odd, length)
    assert repeat_spans.repeat_report(nothing, length=length).count() == 0


def test_repeats_of_planted_passages(spark):
    """Passages of many lengths, near-periodic texts, overlaps, edits, and a tiny alphabet; chunk borders inside texts."""
    rng = np.random.default_rng(3)
    draw = lambda n, k: "".join(rng.choice(list("abcdefghijklmnop"[:k]), n))
    rows, passages = [], [draw(n, 16) for n in (39, 40, 41, 47, 72, 73, 130, 400)]
    for i in range(60):
        parts = []
        for p in rng.permutation(len(passages))[:4]:
            a = int(rng.integers(0, 5))
            parts += [draw(int(rng.integers(1, 90)), 16), passages[p][a:]]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, draw(300, 2)) for i in range(4)] + [(200, "abc" * 90), (201, draw(10, 16) + "abc" * 40), (202, "é" * 100 + draw(50, 16))]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40)


def test_repeats_across_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(repeat_spans, "CHUNK", 64)
    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("abcdefgh"), 700))
    first = repeat_spans.removed_runs
    raw = np.frombuffer(a.encode(), np.uint8)
    whole = [(0, raw)]
    parts = list(repeat_spans.chunks(raw, 50))
    assert len(parts) > 5 and first is repeat_spans.removed_runs
    # A start's sampled place is the same whichever chunk it is seen in.
    place = {}
    for base, piece in whole + parts:
        if base == 0 and len(piece) == len(raw):
            monkeypatch.setattr(repeat_spans, "CHUNK", 1 << 20)
        lo, hi, at, _ = repeat_spans.sample(piece, 50)
        for s, e, p in zip(lo, hi, at):
            for k in range(s, e + 1):
                assert place.setdefault(base + k, base + p) == base + p


# --- 7 ----------------------------------------------------------------------------------------------------


def check_tokens(df):
    library = tokenizer(vocabulary(BYTES))
    want = Counter()
    for i, t in texts(df):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[i, len(t.encode()), n, n > 1024] += 1
    assert Counter(map(tuple, overlap_tokens.count_tokens(df, vocabulary(BYTES)).collect())) == want


def test_token_counts(spark, documents, odd, nothing):
    check_tokens(documents)
    check_tokens(odd)
    assert overlap_tokens.count_tokens(nothing, vocabulary(BYTES)).count() == 0


TRICKY = [
    "it's we'll I'M they've 'tis", "  two  spaces   three\n\n lines \n x", "a <|endoftext|> b<|endoftext|><|endoftext|> c<|endo ftext|>", "tab\tand nbsp em 　x\x1cy \x85z",
    "1234 56,78 ... !!! (a)b[c]", " \n", "é́ 日本語 テスト \U0001f600\U0001f600", "   ", "x" * 50 + " " * 40 + "y", "a\n b\r\n  c", "ǅ İ ß ſ Σας ΌΣΟΣ", "word. word, word.. word., a.b,c .",
]


@pytest.mark.parametrize("text", TRICKY)
def test_pieces_equal_the_library(text):
    from tidemark.llm.piecewise import SpacedCounts, WordIds, little

    spaced, words = SpacedCounts(vocabulary(BYTES)), WordIds(vocabulary(WORDS))
    for _ in range(2):
        assert spaced.count(text) == len(tokenizer(vocabulary(BYTES)).encode(text, add_special_tokens=False).ids)
        assert words.encode(text) == little(tokenizer(vocabulary(WORDS)).encode(text, add_special_tokens=False).ids)


def test_words_of_letters_equal_the_library(spark):
    """All two-byte letters and some beyond, alone, doubled and in words; and every word of a table."""
    from tidemark.llm.piecewise import WordIds, little

    words, library = WordIds(vocabulary(WORDS)), tokenizer(vocabulary(WORDS))
    letters = [chr(c) for c in range(1, 0x900) if chr(c).isalpha()] + list("ﬁẞἈ中がｱ𝔘")
    cases = {f for c in letters for f in (c, c + c, "a" + c, c + "b", "X" + c + "yz", "e" + c + "\u0301")}
    cases |= {w for _, t in texts(table(spark, SMALL, "documents")) for w in t.split()}
    for case in cases:
        assert words.encode(case) == little(library.encode(case, add_special_tokens=False).ids), case


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (150, 16), (400, 100)])
def test_spliced_counts_equal_whole_ones(documents, chunk, overlap):
    library = tokenizer(vocabulary(BYTES))
    rng = np.random.default_rng(2)
    cases = [t for _, t in texts(documents.limit(25))] + [" ".join(rng.choice(TRICKY, 40)) for _ in range(20)] + ["".join(rng.choice(TRICKY, 30)) for _ in range(20)]
    cases += ["x" * 3000, " " * 3000, "ab " * 900, "<|endoftext|>" * 200, "a" * 500 + " " * 500 + "b" * 500, "日本語" * 500]
    for text in cases:
        assert overlap_tokens.spliced_count(text, library, chunk, overlap) == len(library.encode(text, add_special_tokens=False).ids)


# --- 8 ----------------------------------------------------------------------------------------------------


def check_packing(df, slack=0.0):
    library = tokenizer(vocabulary(WORDS))
    want = Counter()
    for i, t in texts(df):
        ids = tuple(library.encode(t, add_special_tokens=False).ids) + (1,)
        want[i, len(ids)] += 1
    rows = tier_packing.pack_documents(df, vocabulary(WORDS)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    by_id = defaultdict(list)
    for i, t in texts(df):
        by_id[i].append(np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes())
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert any(r["ids_crc32"] == zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["doc_tokens"] == len(b) // 4 for b in by_id[r["doc_id"]])
    assert {i: sum(r["length"] for r in rs) for i, rs in docs.items()} == {i: sum(len(b) // 4 for b in bs) for i, bs in by_id.items()}
    for i, rs in docs.items():
        if len(by_id[i]) == 1:
            at = 0
            for r in sorted(rs, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs[:-1]]).tolist()
        total = sum(r["length"] for r in rs)
        assert total == rs[0]["window"] and total <= 2048 and total & (total - 1) == 0 and len({r["step_group"] for r in rs}) == 1
    steps = Counter()
    for rs in sequences.values():
        steps[rs[0]["step_group"]] += rs[0]["window"]
    assert max(steps.values(), default=0) <= tier_packing.STEP_TOKENS
    return rows


def test_packing(spark, documents, odd, nothing):
    rows = check_packing(documents.coalesce(1))
    full = sum(r["length"] for r in rows if r["window"] >= 256)
    assert full / sum(r["length"] for r in rows) > 0.99
    check_packing(odd)
    assert tier_packing.pack_documents(nothing, vocabulary(WORDS)).count() == 0


def test_packer_holds_little_and_loses_nothing():
    rng = np.random.default_rng(8)
    for shape in ("short", "mixed", "long"):
        out, held = Counter(), 0
        packer = tier_packing.TierPacker(lambda pieces, window: out.update({d: n for d, _, n in pieces} if len({d for d, _, _ in pieces}) == len(pieces) else Counter(d for d, _, n in pieces for _ in range(n))))
        sizes = rng.integers(1, {"short": 60, "mixed": 3000, "long": 9000}[shape], 1500)
        for k, n in enumerate(sizes.tolist()):
            packer.add(k, n)
            if packer.held > 50_000:
                packer.pack()
                held = max(held, packer.held)
        packer.finish()
        assert dict(out) == dict(enumerate(sizes.tolist())) and held < 5_000


# --- 9 ----------------------------------------------------------------------------------------------------


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = QUERIES["op9_boosted_quality"](spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["quality"], r["score"]) for r in rows if r["held_out"]]
    y, s = np.array([q for q, _ in held]), np.array([v for _, v in held])
    assert area(y, s) > 0.95 and ((s >= 0.5) == y).mean() > 0.93


def test_trees_fit_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(boosted_quality.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] < -0.3)).astype(float)
    trees = boosted_quality.fit(x, y, trees=30, depth=3)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row, t, node=0):
        if node >= trees.feature.shape[1]:
            return trees.leaf[t, node - trees.feature.shape[1]]
        return walk(row, t, 2 * node + 1 + int(row[trees.feature[t, node]] > trees.threshold[t, node]))

    slow = [1 / (1 + np.exp(-(trees.base + sum(walk(row, t) for t in range(30))))) for row in x[:50]]
    assert np.allclose(slow, trees.score(x[:50]))


def test_quality_counts_an_id_once(spark, monkeypatch):
    """Documents that repeat an id do not grow what is gathered for training."""
    fitted = []
    monkeypatch.setattr(boosted_quality, "fit", lambda x, y: fitted.append(len(y)))
    docs = spark.createDataFrame([(k % 6, f"text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    boosted_quality.train(docs, labels)
    assert fitted == [sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(6))]


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(6, 1), (8, 0), (9, 0), (9, 1), (None, 1), (4, None), (12, 1), (11, 0)], "doc_id long, quality int")
    trees = boosted_quality.train(odd, labels)
    rows = boosted_quality.score(odd.drop("score"), trees).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert boosted_quality.train(nothing, labels).score(np.zeros((2, len(boosted_quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert boosted_quality.score(nothing, trees).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------


def check_shards(df, shards=24):
    rows = kd_shards.shard_documents(df, shards).collect()
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    return sizes, rows


def test_shards(spark):
    df = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    sizes, rows = check_shards(df)
    mean, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) <= max(0.05 * mean, largest)
    text = dict(texts(df))
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 3


def test_shards_part_a_hot_group(spark):
    rows = [(k, "same text in very many rows") for k in range(3000)] + [(5000 + k, f"text {k} " * (k % 9)) for k in range(1500)]
    sizes, _ = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.97 * sum(sizes.values()) / 8


def test_shards_part_repeated_rows(spark):
    """Equal rows, and copies under a null id, beside others: sizes stay near equal and slots gapless."""
    rows = [(1, "the same row " * 8)] * 2000 + [(None, "no id " * 20)] * 1500 + [(5000 + k, f"text {k} " * (k % 9)) for k in range(1500)]
    sizes, _ = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) <= 0.03 * mean + 130


def test_shards_odd(spark, odd, nothing):
    check_shards(odd)
    assert kd_shards.shard_documents(nothing).count() == 0
    assert check_shards(odd, 1)[0].keys() == {0}


def test_pseudo_likelihood_words_of_many_texts_at_once(spark, monkeypatch):
    """Words, places and neighbours of texts side by side are those of each text by itself, however texts are gathered."""
    rng, odds = np.random.default_rng(3), ["", "  ", "\t a\x0b B\x0c\r\n", " x  y", "A\x1cB  c", "İ ß K"]
    said = [*odds, *(" ".join(f"W{w}" for w in rng.zipf(1.3, rng.integers(0, 60))) for _ in range(200)), *odds]
    found, bounds = pseudo_likelihood.split(said)
    assert [found[a:b].to_pylist() for a, b in zip(bounds[:-1], bounds[1:])] == [pseudo_likelihood.words_of(t) for t in said]
    every = [w for t in said for w in pseudo_likelihood.words_of(t)]
    words = pseudo_likelihood.Vocabulary({w: k for k, w in enumerate(sorted(set(every))[:300])})
    words.hold(sorted(set(every))[300:320], [-1.0] * len(sorted(set(every))[300:320]))
    framed, side, edge = words.framed(said), pseudo_likelihood.SIDE, pseudo_likelihood.EDGE
    near, want = framed.neighbours(np.arange(len(every))), []
    for t in said:
        tokens = [words.get(w, pseudo_likelihood.KNOWN + zlib.crc32(w) % pseudo_likelihood.MEMBERS) for w in pseudo_likelihood.words_of(t)]
        padded = [edge] * side + tokens + [edge] * side
        want += [[padded[k + j] for j in (0, 1, 3, 4)] for k in range(len(tokens))]
        assert words.tokens(t).tolist() == tokens
    assert near.tolist() == want
    docs = spark.createDataFrame([(t,) for t in said], "text string").coalesce(1)
    for size in (1, 100, 1 << 22):
        monkeypatch.setattr(pseudo_likelihood, "AT_ONCE", size)
        counts = docs.mapInArrow(pseudo_likelihood._counted, "word binary, n bigint").groupBy("word").sum("n").collect()
        assert {bytes(r[0]): r[1] for r in counts} == dict(Counter(every))
