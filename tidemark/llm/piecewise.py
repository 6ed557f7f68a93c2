"""Tokenizer results of the pieces between white space, kept per Python worker.

The rules that split a text before the merges never let a token reach across certain
places, so a text's tokens are those of its pieces in turn. Natural text repeats its words,
and a look-up is far cheaper than a merge. The store is emptied when it is full, which costs
time but changes nothing.
"""

from __future__ import annotations

import array
import sys

from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.common import tokenizer

#: Pieces kept per worker and file; some 150 bytes each.
KEPT = 700_000


class WordIds:
    """Ids of texts under a tokenizer that drops white space and lower-cases (word-level pieces).

    White space is removed before the merges, so any cut at ASCII white space is exact. A
    full stop or comma after a letter is a piece of its own in the tokenizer's rules.
    ASCII pieces are lower-cased up front, others are left to the library.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.ids: dict[str, bytes] = {}
        # The signs that stand for bytes in the vocabulary, as the library shows them for all two-byte characters.
        letters = "".join(map(chr, range(0x80, 0x800)))
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(letters)[0][0]
        self.signs = {b: s for b, s in zip(letters.encode(), shown)}

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word that its rules leave whole: letters only. It goes straight to the merges."""
        if not word.isalpha():
            return None
        if word.isascii():
            word = word.lower()
        else:
            word = self.library.normalizer.normalize_str(word)
            if not word.isalpha() or max(word) > "\u07ff":  # beyond the probed signs
                return None
            word = word.encode().decode("latin-1").translate(self.signs)
        return little([t.id for t in self.library.model.tokenize(word)])

    def _learn(self, words: set[str]) -> None:
        if len(self.ids) > KEPT:
            self.ids.clear()
        # A full stop or comma after a letter stands alone, so the word before it is looked up without.
        ended = {w for w in words if len(w) > 1 and w[-1] in ".," and w[-2].isalpha()}
        plain = [w for w in {*(words - ended), *(w[:-1] for w in ended), ".", ","} if w not in self.ids]
        other = []
        for word in plain:
            if (ids := self._letters(word)) is None:
                other.append(word)
            else:
                self.ids[word] = ids
        for word, encoding in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            self.ids[word] = little(encoding.ids)
        for word in ended:
            self.ids[word] = self.ids[word[:-1]] + self.ids[word[-1]]

    def encode(self, text: str) -> bytes:
        """All ids of a text, each as a little-endian unsigned 32-bit number."""
        # Only ASCII white space cuts: str.split() would also cut at marks that the tokenizer keeps.
        for mark in "\t\n\v\f\r":
            text = text.replace(mark, " ")
        words = (text.lower() if text.isascii() and "<|" not in text else text).split(" ")  # special tokens are case-sensitive
        found = list(map(self.ids.get, words))
        if None in found:
            missing = {w for w, f in zip(words, found) if f is None}
            # A full store is emptied first, so all words of the text are learned together.
            self._learn(missing if len(self.ids) <= KEPT else set(words))
            found = list(map(self.ids.__getitem__, words))
        return b"".join(found)


def little(ids: list[int]) -> bytes:
    numbers = array.array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class SpacedCounts:
    """Token counts of texts under a byte-level tokenizer whose pieces may start with one space.

    A single space between two characters that are not white space always starts a new piece,
    and no special token holds a space, so a text may be cut before each such space.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        parts = text.split(" ")
        # Parts that are empty or touch other white space are glued back to what precedes them.
        pieces = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace() and pieces[-1] and not pieces[-1][-1].isspace():
                pieces.append(" " + part)
            else:
                pieces[-1] += " " + part
        known = self.counts
        missing = [p for p in set(pieces) if p not in known]
        if missing:
            if len(known) > KEPT:
                known.clear()
                missing = list(set(pieces))
            for piece, encoding in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False)):
                known[piece] = len(encoding)
        return sum(map(known.__getitem__, pieces))
