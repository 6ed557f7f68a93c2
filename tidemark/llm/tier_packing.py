"""Hierarchical packing: context-size tiers, gaps of long windows filled from shorter tiers, even step groups."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, small_batches, whole
from tidemark.llm.piecewise import WordIds

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that a task holds while it packs; what is left over goes on to the next block.
BLOCK_TOKENS = 1 << 20
#: Tokens of a step group: 8 windows of 2048, 16 of 1024 and so on.
STEP_TOKENS = 8 * TIERS[-1]
#: Sequence ids: the partition's number, then a count within it.
PARTITION_SHIFT = 40

# A piece: number of its document, first token in it, tokens.
Piece = tuple[int, int, int]


class TierPacker:
    """Packs documents' token counts into windows; knows no texts."""

    def __init__(self, emit: Callable[[list[Piece], int], None], tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers = emit, tiers
        self.waiting: dict[int, list[Piece]] = {w: [] for w in tiers}
        self.held = 0

    def _route(self, piece: Piece) -> None:
        """To the smallest window that holds it."""
        self.waiting[next(w for w in self.tiers if piece[2] <= w)].append(piece)

    def add(self, doc: int, tokens: int) -> None:
        longest, start = self.tiers[-1], 0
        while tokens - start >= longest:
            self.emit([(doc, start, longest)], longest)
            start += longest
        if start < tokens:
            self._route((doc, start, tokens - start))
            self.held += tokens - start

    def _fill(self, gap: int, below: tuple[int, ...]) -> list[Piece]:
        """Pieces of shorter tiers for a gap, the longest that fit first; the last one is cut to fit."""
        got: list[Piece] = []
        for window in reversed(below):
            while gap and self.waiting[window]:
                doc, start, length = self.waiting[window][-1]
                if length > gap:
                    break
                self.waiting[window].pop()
                got.append((doc, start, length))
                gap -= length
        for window in below:
            if gap and self.waiting[window]:
                doc, start, length = self.waiting[window].pop()  # longer than the gap, or it would have fit
                got.append((doc, start, gap))
                self._route((doc, start + gap, length - gap))
                gap = 0
        return got

    def pack(self) -> None:
        """Windows of all tiers, longest first; gaps take shorter tiers first, then a cut piece of their own."""
        for k in range(len(self.tiers) - 1, -1, -1):
            window, later = self.tiers[k], []
            while self.waiting[window]:
                piece = self.waiting[window].pop()
                got = [piece, *self._fill(window - piece[2], self.tiers[: k + 1])]
                if sum(p[2] for p in got) == window:
                    self.emit(got, window)
                else:
                    later += got
            for piece in later:
                self._route(piece)
        self.held = sum(p[2] for pieces in self.waiting.values() for p in pieces)

    def finish(self) -> None:
        """What no tier could fill becomes one stream, cut into the longest windows and then powers of two."""
        self.pack()
        rest = [p for w in reversed(self.tiers) for p in self.waiting[w]]
        tokens = sum(p[2] for p in rest)
        longest = self.tiers[-1]
        sizes = [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if tokens % longest >> b & 1]
        at = 0
        for size in sizes:
            got, need = [], size
            while need:
                doc, start, length = rest[at]
                cut = min(need, length)
                got.append((doc, start, cut))
                need -= cut
                if cut == length:
                    at += 1
                else:
                    rest[at] = (doc, start + cut, length - cut)
            self.emit(got, size)
        self.waiting = {w: [] for w in self.tiers}
        self.held = 0


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``,
    and its sequence's ``window`` and ``step_group``.

    A document's ids and ``end_id`` are cut into full windows of the longest tier; the rest goes to the
    smallest tier that holds it, longer windows first take shorter pieces into their gaps, and
    what remains at the end of a partition is cut into powers of two. So each sequence is exactly
    as long as its window and needs no padding. A step group is a run of sequences of one window
    that holds the same number of tokens as any other (the last ones of a partition may hold fewer).

    Packing happens where the rows are: no shuffle, a bounded block of pieces in memory, ids that
    depend on the partition's number alone, so a task that is run again gives the same rows.
    A null or empty text is its end id alone; repeated rows are packed each; null ids stay null; an
    empty table gives no rows; other columns are ignored.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(path)
        end = int(end_id).to_bytes(4, "little")
        out: list[tuple] = []
        open_docs: dict[int, tuple[object, bytes, int]] = {}  # number: id, ids as bytes, tokens not yet placed
        count, filled = 0, dict.fromkeys((1 << b for b in range(TIERS[-1].bit_length())), 0)
        first = TaskContext.get().partitionId() << PARTITION_SHIFT

        def emit(pieces: list[Piece], window: int) -> None:
            nonlocal count
            offset = 0
            step = first + (window.bit_length() << 32) + filled[window] // (STEP_TOKENS // window)
            for doc, start, length in pieces:
                name, ids, left = open_docs[doc]
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                out.append((name, start, length, crc, len(ids) // 4, first + count, offset, window, step))
                offset += length
                if left == length:
                    del open_docs[doc]
                else:
                    open_docs[doc] = (name, ids, left - length)
            count += 1
            filled[window] += 1

        def rows() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=COLUMNS)
            out.clear()
            return frame

        packer, number = TierPacker(emit), 0
        for batch in batches:
            for name, text in zip(batch["id"].tolist(), batch["text"]):
                ids = words.encode(text) + end
                number += 1
                open_docs[number] = (name, ids, len(ids) // 4)
                packer.add(number, len(ids) // 4)
                if packer.held >= BLOCK_TOKENS:
                    packer.pack()
                if len(out) >= 50_000:
                    yield rows()
        packer.finish()
        yield rows()

    small_batches(docs.sparkSession)
    # Ids travel as text, so that a null among whole numbers does not turn the others into floats.
    source = narrow(docs, id=F.col(f"`{id_col}`").cast("string"), text=whole(f"`{text_col}`"))
    out = source.mapInPandas(packed, SCHEMA)
    kind = dict(docs.dtypes)[id_col]
    return out.select(F.col("id").cast(kind).alias(id_col), *COLUMNS[1:])


SCHEMA = (
    "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "window int, step_group bigint"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
_kept: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    return _kept.setdefault(path, WordIds(path))
