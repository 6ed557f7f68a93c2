"""Masked pseudo-likelihood: a window network that predicts each token from both sides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import Scratch, narrow, small_batches, whole

#: Output classes times words per class; the last class takes hash buckets of words outside the vocabulary.
CLASSES, MEMBERS = 64, 64
KNOWN = (CLASSES - 1) * MEMBERS
EDGE = CLASSES * MEMBERS  # what stands beyond either end of a text
SIDE = 2  # tokens seen on either side
WIDTH = 16
#: One token in MASKED is predicted while training, each document in turn at other places; scoring predicts all.
MASKED = 8
EPOCHS, BATCH, RATE = 2, 2048, 0.08
#: Pieces that partitions' networks are summed in.
PIECES = 64
#: Tokens scored at once.
BLOCK = 1 << 15
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
#: Words after the vocabulary whose shares of their buckets every worker holds; those of all other words are joined.
NEAR = 1 << 17
#: Bytes of texts whose words are looked up at once; a longer text by itself.
AT_ONCE = 1 << 22


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts have some AT_ONCE bytes, as a look-up costs as much again as it has words."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // AT_ONCE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                more = int(ends[b - 1] - (ends[a - 1] if a else 0))
                if held and size + more > AT_ONCE:
                    yield pa.concat_batches(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += more
    if held:
        yield pa.concat_batches(held)


def split(texts: pa.Array | list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, as ``words_of`` has them, and the bounds of each text's."""
    if isinstance(texts, list):
        texts = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.values.view(pa.binary())
    filled = pc.greater(pc.binary_length(words), 0)  # white space at the ends leaves empty words
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), before[parts.offsets.to_numpy()]


def listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Vocabulary(dict):
    """Word to token; a word outside falls into one of the last class's buckets by its checksum.

    A bucket's probability is parted among its words: ``shares`` is a table (word, share) of the counted words outside,
    each with the logarithm of its share; ``left`` is what each bucket leaves to words that were never counted. Those part
    the sum of all that is left by their spelling: ``spelling`` holds the log-probability of each byte after
    another, a space standing at both ends, and ``unseen`` the logarithm of what the counted words take of it.

    The most frequent words outside, NEAR at most, are held here with their shares, as most tokens outside are such;
    ``rare`` is the table of all others.
    """

    shares: DataFrame
    rare: DataFrame
    left: np.ndarray  # (MEMBERS,)
    spelling: np.ndarray  # (256, 256)
    unseen: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("shares", "rare")}

    def hold(self, near: list[bytes], shares: list[float]) -> None:
        self.held = pa.array([*self, *near], pa.binary())
        self.place_at = np.concatenate([np.fromiter(self.values(), np.int64, len(self)), np.arange(EDGE + 1, EDGE + 1 + len(near))])
        self.token_at = np.concatenate([np.arange(EDGE + 1), [KNOWN + crc32(w) % MEMBERS for w in near]]).astype(np.int64)
        self.share_at = np.concatenate([np.zeros(EDGE + 1), shares])

    def places_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of each word: its token, beyond EDGE a word whose share is held; all others get the token of their bucket, and are given with their positions."""
        at = pc.index_in(words, value_set=self.held).fill_null(-1).to_numpy()
        rest = np.flatnonzero(at < 0)
        places, others = self.place_at[at] if len(self.place_at) else np.empty(len(at), np.int64), listed(words.take(pa.array(rest)))
        places[rest] = np.fromiter((KNOWN + crc32(w) % MEMBERS for w in others), np.int64, len(rest))
        return places, rest, others

    @property
    def places(self) -> dict[bytes, int]:
        """The words that are held, with their places."""
        return dict(zip(listed(self.held), self.place_at.tolist()))

    def framed(self, texts: pa.Array | list[str]) -> Framed:
        words, bounds = split(texts)
        return Framed(self.token_at[self.places_of(words)[0]], bounds)

    def tokens(self, text: str) -> np.ndarray:
        return self.framed([text]).tokens

    def weighed(self, words: list[bytes], gaps: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct ones of a text's words outside, how often each occurs, and what each adds if it was never counted.

        ``gaps``: by how much the log-probability of any uncounted word exceeds that of the word's bucket.
        """
        found: dict[bytes, int] = {}
        index = np.fromiter((found.setdefault(w, len(found)) for w in words), np.int64, len(words))
        if not found:
            return [], np.zeros(0, np.int64), np.zeros(0)
        times = np.bincount(index)
        return list(found), times, np.bincount(index, gaps) + times * (_spelled(self.spelling, list(found)) - self.unseen)


def _bytes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)


def _spelled(spelling: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log-probability of each word among all that can be spelled."""
    run = _bytes(words)
    return np.add.reduceat(spelling[run[:-1], run[1:]], np.cumsum([0, *(len(w) + 1 for w in words[:-1])]))


#: Logarithms up to this size are raised to exponents as they are: sums of a row stay finite and positive in 32 bits.
SAFE = 80.0


def _raised(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a softmax layer: its logits, their exponentials up to a factor per row, and these summed by row.

    As no entry of ``h`` exceeds 1, the weights bound the logits; the greatest of each row is taken off only if they may be too large.
    """
    logits = h @ weights
    if np.abs(weights).sum(0).max() > SAFE:
        logits -= logits.max(-1, keepdims=True)
    raised = np.exp(logits)
    return logits, raised, raised @ np.ones(raised.shape[1], raised.dtype)


@dataclass
class Network:
    """The neighbours' vectors, one table per place, add up to a hidden layer; it predicts class, then word in class."""

    places: np.ndarray  # (2 * SIDE, EDGE + 1, WIDTH)
    bias: np.ndarray  # (WIDTH,)
    classes: np.ndarray  # (WIDTH + 1, CLASSES); the last row is a bias
    members: np.ndarray  # (CLASSES, WIDTH + 1, MEMBERS)

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Random small vectors; the output biases start at the corpus frequencies."""
        rng = np.random.Generator(np.random.PCG64(7))
        share = (counts + 0.5).reshape(CLASSES, MEMBERS)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        out = cls(draw(2 * SIDE, EDGE + 1, WIDTH), np.zeros(WIDTH, np.float32), draw(WIDTH + 1, CLASSES), draw(CLASSES, WIDTH + 1, MEMBERS))
        out.classes[-1] = np.log(share.sum(1) / share.sum())
        out.members[:, -1] = np.log(share / share.sum(1, keepdims=True))
        return out

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.places, self.bias, self.classes, self.members)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        shapes = [(2 * SIDE, EDGE + 1, WIDTH), (WIDTH,), (WIDTH + 1, CLASSES), (CLASSES, WIDTH + 1, MEMBERS)]
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return cls(*(p.reshape(s).copy() for p, s in zip(parts, shapes)))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.places[0].take(near[:, 0], 0)
        for k in range(1, 2 * SIDE):
            total += self.places[k].take(near[:, k], 0)
        total += self.bias
        out = np.ones((len(near), WIDTH + 1), np.float32)
        np.tanh(total, out=out[:, :-1])
        return out

    def _by_class(self, near: np.ndarray, target: np.ndarray):
        """The order that sorts targets by class, in which come: hidden layer, classes, words in class; and the bounds of classes."""
        kind = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        kind, member = kind[order], (target % MEMBERS)[order]
        return order, self.hidden(near[order]), kind, member, np.searchsorted(kind, np.arange(CLASSES + 1))

    def log_probability(self, near: np.ndarray, target: np.ndarray, left: np.ndarray | None = None):
        """Of each target token, given its neighbours.

        With ``left`` also that of any uncounted word in the place of each bucket.
        """
        order, h, kind, member, bounds = self._by_class(near, target)
        rows = np.arange(len(target))
        logits, _, total = _raised(h, self.classes)
        found, other = (logits[rows, kind] - np.log(total)).astype(np.float64), np.zeros(len(target))
        for c in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[c], bounds[c + 1])
            logits, raised, total = _raised(h[at], self.members[c])
            if left is not None and c == CLASSES - 1:
                other[at] = found[at] + np.log(raised @ left.astype(np.float32) / total)
            found[at] += logits[rows[: len(total)], member[at]] - np.log(total)
        out = np.empty_like(found)
        out[order] = found
        if left is None:
            return out
        apart = np.empty_like(other)
        apart[order] = other
        return out, apart

    def step(self, near: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step down the batch's mean loss; steps of the look-up tables are per token, as each is seen seldom."""
        order, h, kind, member, bounds = self._by_class(near, target)
        near, n = near[order], len(target)
        rows = np.arange(n)
        _, error, total = _raised(h, self.classes)
        error /= total[:, None]
        error[rows, kind] -= 1
        back = error @ self.classes[:-1].T
        classes = h.T @ error / n
        for c in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[c], bounds[c + 1])
            _, wrong, total = _raised(h[at], self.members[c])
            wrong /= total[:, None]
            wrong[rows[: len(total)], member[at]] -= 1
            back[at] += wrong @ self.members[c, :-1].T
            self.members[c] -= rate * (h[at].T @ wrong) / np.sqrt(len(total))
        self.classes -= rate * classes * np.sqrt(n) / 4
        back *= 1 - h[:, :-1] ** 2
        self.bias -= rate * back.mean(0)
        for k in range(2 * SIDE):
            column = near[:, k].astype(np.uint16)
            by_token = np.argsort(column, kind="stable")
            column = column[by_token]
            first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            count = np.diff(np.append(first, n))
            moved = np.add.reduceat(back[by_token], first, axis=0)
            self.places[k][column[first]] -= (rate * moved / np.sqrt(count)[:, None]).astype(np.float32)


class Framed:
    """The tokens of texts one after another, with EDGE beyond the ends of each."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray):
        self.tokens, self.text = tokens, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.place = np.arange(len(tokens)) - bounds[self.text]  # in its text
        self.framed = np.full(len(tokens) + SIDE * len(bounds), EDGE, np.int64)
        self.framed[np.arange(len(tokens)) + SIDE * (self.text + 1)] = tokens

    def neighbours(self, at: np.ndarray) -> np.ndarray:
        """The SIDE tokens on either side of each."""
        first = at + SIDE * self.text[at]
        return np.stack([self.framed[first + k] for k in range(2 * SIDE + 1) if k != SIDE], 1)


def neighbours(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of one text's tokens."""
    return Framed(tokens, np.array([0, len(tokens)])).neighbours(at)


def _masked(place: np.ndarray, tokens: np.ndarray, epoch: int) -> np.ndarray:
    """Which tokens are predicted in training: each with chance 1 / MASKED, by a hash of its place in its text and itself."""
    mixed = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tokens.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(epoch + 1)) * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(MASKED) == 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[pa.Table] = []

    def rows() -> list[pa.RecordBatch]:
        summed = pa.concat_tables(found).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        found.clear()
        return summed.to_batches()

    for batch in gathered(batches):
        counts = split(batch.column("text"))[0].value_counts()
        found.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
        if sum(map(len, found)) >= COUNTED:
            yield from rows()
    if found:
        yield from rows()


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        if len(batch):
            run = _bytes(batch["word"].tolist()).astype(np.int64)
            total += np.bincount(run[:-1] << 8 | run[1:], minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"pair": seen, "n": total[seen]})


def _part(words: Vocabulary, counts: DataFrame, last) -> None:
    """Parts the buckets among the counted words that come after ``last`` in the vocabulary's order, all others if None.

    As many tokens as there are distinct words outside are set aside for uncounted ones (Witten and Bell's rule). What is
    collected are sums of 64 buckets, of pairs of bytes, and of the counted words' spellings.
    """
    outside = counts.where(F.lit(False))
    if last is not None:
        outside = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > F.lit(bytes(last["word"])))))
    bucket = (F.crc32("word") % MEMBERS).cast("int")
    tokens, kinds = np.zeros(MEMBERS), 0
    for r in outside.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tokens[r["bucket"]], kinds = r["n"], kinds + r["kinds"]
    aside = (kinds + 1) / (tokens.sum() + kinds + 2)
    words.left = np.where(tokens > 0, aside, 1.0)
    scale = F.array(*(F.lit(float(x)) for x in np.log1p(-aside) - np.log(np.maximum(tokens, 1))))
    shares = outside.select("word", (F.log("n") + scale[bucket]).alias("share"), "n")
    # Counts whose words are held whole: how many words have each count is a short table.
    least, room = None, NEAR
    for r in outside.groupBy("n").agg(F.count("*").alias("kinds")).orderBy(F.col("n").desc()).limit(NEAR).collect():
        room -= r["kinds"]
        if room < 0:
            break
        least = r["n"]
    held = [] if least is None else shares.where(F.col("n") >= least).orderBy("word").collect()
    words.hold([bytes(r["word"]) for r in held], [r["share"] for r in held])
    words.shares = shares.drop("n")
    words.rare = (shares if least is None else shares.where(F.col("n") < least)).drop("n")

    pairs = np.full((256, 256), 0.5)
    pairs[:, list(b"\t\n\v\f\r")] = pairs[ord(" "), ord(" ")] = 0  # no word holds them, none is empty
    for r in counts.mapInPandas(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[divmod(r["pair"], 256)] += r["n"]
    with np.errstate(divide="ignore"):
        words.spelling = spelling = np.log(pairs / pairs.sum(1, keepdims=True))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"p": [float(sum(np.exp(_spelled(spelling, b["word"].tolist())).sum() for b in batches if len(b)))]})

    words.unseen = float(np.log(max(1 - counts.mapInPandas(spelled, "p double").agg(F.sum("p")).first()[0], 1e-12)))


def train(docs: DataFrame, text_col: str = "text", epochs: int = EPOCHS) -> tuple[Vocabulary, Network] | None:
    """The vocabulary (the corpus's most frequent words) and the network, fitted on all documents.

    Word counts are combined by shuffle and the top KNOWN words reach the driver. In an epoch each partition starts from the
    same network, steps through the masked places of all its documents, and gives its network and how many
    tokens it saw; their weighted mean, summed by shuffle in pieces, starts the next epoch. The network's size
    is fixed, so what the driver holds is bounded; what is gathered grows with the corpus. All other words keep
    their counts in a table, by which they part the probability of their bucket. None without any word.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    texts = narrow(docs, text=whole(f"`{text_col}`"))
    counts = texts.mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Scratch(spark, "words").table(counts, "counts")
    top = counts.orderBy(F.col("n").desc(), "word").limit(KNOWN).collect()
    if not top:
        return None
    words = Vocabulary({bytes(r["word"]): k for k, r in enumerate(top)})
    total = counts.agg(F.sum("n")).first()[0]
    frequency = np.zeros(CLASSES * MEMBERS)
    frequency[: len(top)] = [r["n"] for r in top]
    frequency[KNOWN:] = (total - frequency.sum()) / MEMBERS
    network = Network.fresh(frequency)
    _part(words, counts, top[-1] if len(top) == KNOWN else None)
    for epoch in range(epochs):
        start = spark.sparkContext.broadcast((words, network.vector()))
        rate = RATE * 0.5**epoch

        def fitted(batches: Iterator[pa.RecordBatch], start=start, epoch=epoch, rate=rate) -> Iterator[pa.RecordBatch]:
            known, flat = start.value
            own, near, target, seen = Network.of(flat), [], [], 0

            def learn(last: bool) -> None:
                nonlocal near, target
                x, y = np.concatenate(near), np.concatenate(target)
                until = len(y) if last else len(y) // BATCH * BATCH
                for k in range(0, until, BATCH):
                    own.step(x[k : k + BATCH], y[k : min(k + BATCH, until)] if last else y[k : k + BATCH], rate)
                near, target = [x[until:]], [y[until:]]

            held = 0
            for batch in gathered(batches):
                framed = known.framed(batch.column("text"))
                at = _masked(framed.place, framed.tokens, epoch)
                if len(at):
                    near.append(framed.neighbours(at))
                    target.append(framed.tokens[at])
                    seen, held = seen + len(at), held + len(at)
                    if held >= 16 * BATCH:
                        learn(False)
                        held = len(target[0])
            if seen:
                learn(True)
                # Rows of words that this partition lacks have not moved: zeros, which shuffle files compress.
                moved = (own.vector() - flat) * np.float32(seen)
                sums = pa.array(np.array_split(moved, PIECES), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()), sums], ["piece", "seen", "sums"])

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for piece, seen, more in zip(batch["piece"], batch["seen"], batch["sums"]):
                    n, before = sums.get(piece, (0, 0.0))
                    sums[piece] = (n + seen, before + np.asarray(more, np.float64))
            yield pd.DataFrame([(k, n, x) for k, (n, x) in sums.items()], columns=["piece", "seen", "sums"])

        steps = texts.mapInArrow(fitted, "piece int, seen bigint, sums array<float>")
        # Each piece of the network is summed in one task, row by row as they arrive.
        got = steps.repartition(PIECES, "piece").mapInPandas(added, "piece int, seen bigint, sums array<double>").orderBy("piece").collect()
        if got:
            network = Network.of(network.vector() + np.concatenate([r["sums"] for r in got]) / got[0]["seen"])
        start.unpersist()
    return words, network


def score(docs: DataFrame, model: tuple[Vocabulary, Network] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``log_likelihood`` (sum over all tokens), ``mean_log_likelihood``.

    Null and blank texts have no tokens, a sum of 0 and a null mean; repeated rows score alike; texts of any length
    are predicted whole, a block of tokens at a time; an empty table gives no rows. Words outside the vocabulary
    get the probability of their bucket there and their share of it: the more frequent ones by what the workers
    hold, all others by a join with the counted words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(None if model is None else (model[0], model[1].vector()))
    loaded: dict = {}

    def scored(texts: pa.Array) -> list[Sequence]:
        """Sizes, sums, and of each text's words outside: themselves, how often, and what they add if they were never counted."""
        if sent.value is None:
            return [[0] * len(texts), [0.0] * len(texts), *([[]] * len(texts) for _ in range(3))]
        if "network" not in loaded:
            loaded["words"], loaded["network"] = sent.value[0], Network.of(sent.value[1])
        known = loaded["words"]
        words, bounds = split(texts)
        place, rest, others = known.places_of(words)
        framed = Framed(known.token_at[place], bounds)
        sums, gaps = np.bincount(framed.text, known.share_at[place], len(texts)), np.zeros(len(place))
        for a in range(0, len(place), BLOCK):
            at = np.arange(a, min(a + BLOCK, len(place)))
            p, other = loaded["network"].log_probability(framed.neighbours(at), framed.tokens[at], known.left)
            sums += np.bincount(framed.text[at], p, len(texts))
            gaps[at] = other - p
        cut = np.searchsorted(rest, bounds)
        outside = [others[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return [np.diff(bounds), sums, *zip(*map(known.weighed, outside, np.split(gaps[rest], cut[1:-1])))]

    outputs = "n_tokens bigint, log_likelihood double, word array<binary>, times array<bigint>, unseen array<double>"
    schema = to_arrow_schema(StructType.fromDDL(outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            made = [pa.array(v, f.type) for v, f in zip(scored(batch.column("text")), schema)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", *schema.names])

    source = narrow(docs, id=id_col, text=whole(f"`{text_col}`"))
    small_batches(spark)
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, {outputs}")
    if model is None:
        out = out.drop("word", "times", "unseen")
    else:
        base = Scratch(spark, "likelihood").table(out.withColumn("row", F.monotonically_increasing_id()), "base")
        pairs = base.select("row", F.inline(F.arrays_zip("word", "times", "unseen"))).join(model[0].rare, "word", "left")
        # Sums of whole numbers come out alike in any order.
        more = F.round(F.coalesce(F.col("times") * F.col("share"), F.col("unseen")) * (1 << 30)).cast("bigint")
        parted = pairs.groupBy("row").agg((F.sum(more) / (1 << 30)).alias("more"))
        whole_sum = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
        out = base.join(parted, "row", "left").select("id", "n_tokens", whole_sum.alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_likelihood", mean).withColumnRenamed("id", id_col)
