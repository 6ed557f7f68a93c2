"""Token counts of whole texts; huge ones by overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import computed, narrow, tokenizer, whole
from tidemark.llm.piecewise import SpacedCounts

#: Characters of a chunk and, at first, of the overlap of two.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Boundaries this near a chunk's cut end prove nothing: the cut may hide a special token.
MARGIN = 64


def piece_starts(encoding) -> dict[int, int]:
    """Where the pieces that are merged apart start: character offset to token index."""
    words, offsets = encoding.word_ids, encoding.offsets
    return {offsets[t][0]: t for t in range(1, len(words)) if words[t] != words[t - 1] and words[t] is not None and words[t - 1] is not None}


def spliced_count(text: str, library, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoding at most a few chunks' worth of it at a time.

    A piece is found from where the one before it ended and from what follows, never from
    what came earlier. If one chunk, read from a known piece start, and the next one, read from
    anywhere before, both start a piece at the same place well before the first one's cut, the
    next chunk is right from there on. With no such place the overlap doubles; once it is as long as
    the chunk, the chunk itself doubles.
    """
    total, begin = 0, 0  # tokens before ``begin``; ``begin`` starts a piece
    base, end = 0, min(len(text), chunk)
    encoding, first = library.encode(text[:end], add_special_tokens=False), 0
    while end < len(text):
        width, known = overlap, {base + at: t for at, t in piece_starts(encoding).items() if t > first}
        while True:
            after = end - width
            if after <= begin:  # no stable place in all of the chunk
                end = min(len(text), end + (end - begin))
                encoding, base, first = library.encode(text[begin:end], add_special_tokens=False), begin, 0
                break
            until = min(len(text), after + max(chunk, 2 * width))
            following = library.encode(text[after:until], add_special_tokens=False)
            common = [(after + at, t) for at, t in piece_starts(following).items() if at > 1 and after + at <= end - MARGIN and after + at in known]
            if common:
                place, token = max(common)
                total += known[place] - first
                begin, base, end, encoding, first = place, after, until, following, token
                break
            width *= 2
    return total + len(encoding.ids) - first


class Counter:
    """Counts the tokens of texts; one per task, with what its worker already knows."""

    kept: dict[str, SpacedCounts] = {}

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.spaced = self.kept.setdefault(path, SpacedCounts(path))

    def __call__(self, text: str) -> int:
        return self.spaced.count(text) if len(text) <= CHUNK else spliced_count(text, self.library)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    Counts are those of the library on the whole text without added tokens, truncation or
    padding. No shuffle, no state beyond a worker's bounded store of pieces. Null and
    empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """

    def counted(texts: list[str]) -> list[list[int]]:
        count = Counter(path)
        return [[count(text) for text in texts]]

    source = narrow(docs, id=id_col, n_bytes=F.octet_length(whole(f"`{text_col}`")).cast("long"), text=whole(f"`{text_col}`"))
    out = computed(source, ["text"], "n_tokens bigint", counted)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
