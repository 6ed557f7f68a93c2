"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import computed, narrow, small_batches, whole

#: Labelled rows that the trees are fitted on at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE = 64, 80, 4, 0.15
#: A leaf's pull towards zero, and the rows (as summed weights) that a side of a split needs.
SHRINK, LEAST_WEIGHT = 1.0, 2.0

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "lower", "upper", "digits", "blanks", "breaks", "other_ascii",
    "wide", "byte_entropy", "common_mark", "full_stops", "commas", "word_variety", "top_word", "pair_repeats", "line_mean",
    "line_repeats", "line_words", "marked_words", "upper_words", "digit_words", "short_words",
)
_LOWER, _UPPER, _DIGIT = slice(97, 123), slice(65, 91), slice(48, 58)


def statistics(text: str) -> list[float]:
    """The features of one whole text; all zero for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digits, wide = counts[_LOWER].sum(), counts[_UPPER].sum(), counts[_DIGIT].sum(), counts[128:].sum()
    blanks, breaks = counts[32], counts[10]
    marks = counts[33:127].copy()
    marks[_shift(_LOWER)] = 0
    marks[_shift(_UPPER)] = 0
    marks[_shift(_DIGIT)] = 0
    share = counts[counts > 0] / n
    words = raw.split()
    w = len(words)
    sizes = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    seen = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    some = max(w, 1)
    last = Counter(word[-1] for word in words)
    marked = sum(c for b, c in last.items() if b < 128 and not (97 <= b < 123 or 65 <= b < 91 or 48 <= b < 58) and b not in (44, 46))
    return [
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), np.log1p(sizes.max()), lower / n, upper / n, digits / n, blanks / n, breaks / n,
        marks.sum() / n, wide / n, float(-(share * np.log2(share)).sum()), marks.max() / n, counts[46] / n, counts[44] / n, len(seen) / some ** 0.75,
        max(seen.values(), default=0) / some, 1 - len(pairs) / max(w - 1, 1), np.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(w / max(len(lines), 1)), marked / some,
        sum(map(bytes.isupper, words)) / some, sum(map(bytes.isdigit, words)) / some, float((sizes <= 3).sum()) / some,
    ]


def _shift(letters: slice) -> slice:
    return slice(letters.start - 33, letters.stop - 33)


def feature_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Full binary trees as arrays: row t holds tree t's nodes level by level, then its leaves."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # same; a row goes right if its value is greater
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows at once: one gather per tree and level."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:  # trees are full: all rows reach their leaves together
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosting on logistic loss; splits are searched in histograms of binned features.

    Without rows, or with one label only, there are no trees and the score is constant
    (0.5 without rows).
    """
    n, width = len(y), x.shape[1] if x.ndim == 2 else len(FEATURES)
    if n == 0 or len(set(y.tolist())) < 2:
        base = 0.0 if n == 0 else float(np.log((y.mean() * n + 0.5) / ((1 - y.mean()) * n + 0.5)))
        return Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    flat = binned + np.arange(width) * bins
    feature, threshold = np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                cut = _best(flat[at], grad[at], hess[at], width, bins)
                if cut is not None and cut[1] < len(edges[cut[0]]):
                    feature[t, k], threshold[t, k] = cut[0], edges[cut[0]][cut[1]]
                    node[at] = 2 * k + 1 + (binned[at, cut[0]] > cut[1])
                else:  # a node that is not split sends all its rows left
                    node[at] = 2 * k + 1
        node -= 2**depth - 1
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        leaf[t] = rate * g / (h + SHRINK)
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def _best(flat: np.ndarray, grad: np.ndarray, hess: np.ndarray, width: int, bins: int) -> tuple[int, int] | None:
    if not len(flat):
        return None
    g = np.bincount(flat.ravel(), np.repeat(grad, width), width * bins).reshape(width, bins).cumsum(1)
    h = np.bincount(flat.ravel(), np.repeat(hess, width), width * bins).reshape(width, bins).cumsum(1)
    right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
    gain = g**2 / (h + SHRINK) + right_g**2 / (right_h + SHRINK) - g[:, -1:] ** 2 / (h[:, -1:] + SHRINK)
    gain[(h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
    best = int(gain.argmax())
    return divmod(best, bins) if gain.flat[best] > 1e-6 else None


def remainder(doc_id: Column, modulus: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, held: int = 1) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents whose id's checksum does not leave ``held``.

    The sample is drawn from the labels alone (smallest id hashes), so it is broadcast within that bound; only its
    documents' texts leave the scan, and only their figures reach the driver. A label that is null, or given twice
    with two values, is left out; of documents that share an id one counts.
    """
    one = narrow(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    sample = one.where((F.col("y") == F.col("z")) & (remainder(F.col("id")) != held)).orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "y")
    chosen = narrow(docs, id=id_col, text=whole(f"`{text_col}`")).join(F.broadcast(sample), "id").select("id", "text", F.col("y").cast("double").alias("y"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "x": list(feature_matrix(batch["text"]))})

    small_batches(docs.sparkSession)
    kind = dict(sample.dtypes)["id"]
    each = chosen.mapInPandas(features, f"id {kind}, y double, x array<float>")
    # One row per id, so that documents which repeat an id cannot outgrow the sample.
    got = each.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["y"].to_numpy()])  # the same trees whatever order rows arrive in
    return fit(x[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score from 0 to 1 added; null and empty texts are scored on zeros.

    One pass over the rows; nothing is shuffled.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = F.col(names[docs.columns.index(text_col)])
    model = docs.sparkSession.sparkContext.broadcast(trees)
    scored = computed(renamed.withColumn("t", whole(text)), ["t"], "s double", lambda texts: [model.value.score(feature_matrix(texts)).tolist()])
    kept = [(n, c) for n, c in zip(names, docs.columns) if c != score_col]
    return scored.select(*(F.col(n).alias(c) for n, c in kept), F.col("s").alias(score_col))
