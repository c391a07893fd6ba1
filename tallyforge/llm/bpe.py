"""Byte-pair encoding with memory, and exact token counts of every prefix.

A text is cut into pieces by the vocabulary's pattern and no merge crosses a
piece, so what one piece encodes to can be remembered.  Most pieces recur, and
whole words with the blank before them recur too.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import pairwise
from operator import sub

import numpy as np
import regex

#: Pattern of the byte-level pre-tokenizer, a fixed value of the vocabulary file's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = regex.compile(r"\s+").match
#: What a worker remembers, which only saves time: so many words for good (the first it meets, which are the common ones), so many for now, so many pairs of tokens, and so many starts of pieces, each of HEAD bytes.
FIRST, LATER, PAIRS, HEADS = 100_000, 50_000, 200_000, 30_000
LONG, HEAD = 64, 5
#: A word and the signs behind it, which are two pieces.
SIGNED = re.compile(r"([^\W\d_]+)([^\w\s]+)").fullmatch


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _NotAlone(Exception):
    """A word that starts or ends with white space, which its neighbours decide on."""


class Words(dict):
    """word -> value of ' ' + word, remembered: one(piece) if that is a piece, else put together from pieces, else many(text).

    The dictionary itself holds the first words, later the single pieces that
    came after; when later is full it starts anew, so the common words are
    never lost and a worker's memory has a bound of some 35 MB.  line is the
    value of a line's end between two words.
    """

    def __init__(self, one, many, line):
        super().__init__()
        self.one, self.many, self.line = one, many, line
        self.signs: dict = {}
        self.later: dict = {}

    def __missing__(self, word):
        value = self.later.get(word)
        if value is not None:
            return value
        if word.isalpha():
            value = self.one(" " + word)
            if len(word) <= LONG and len(self) >= FIRST:
                if len(self.later) >= LATER:
                    self.later.clear()
                self.later[word] = value
        elif (parts := SIGNED(word)) and parts[1].isalpha():
            value = self[parts[1]] + self._signs(parts[2])
        elif not word or word[0].isspace() or word[-1].isspace():
            raise _NotAlone
        elif "\n" in word and not any(not x or x[0].isspace() or x[-1].isspace() for x in word.split("\n")):
            first, *rest = word.split("\n")
            value = self[first]
            for x in rest:
                value += self.line + self._bare(x)
        else:
            value = self.many(" " + word)
        if len(word) <= LONG and len(self) < FIRST:
            self[word] = value
        return value

    def _signs(self, signs):
        value = self.signs.get(signs)
        if value is None:
            value = self.one(signs)
            if len(signs) <= LONG and len(self.signs) <= LATER // 10:
                self.signs[signs] = value
        return value

    def _bare(self, word):
        """Value of a word without a blank before it."""
        if word.isalpha():
            return self.one(word)
        parts = SIGNED(word)
        return self.one(parts[1]) + self._signs(parts[2]) if parts and parts[1].isalpha() else self.many(word)


class Bpe:
    """The encoder of one vocabulary file (byte-level BPE in the JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or ids != sorted(ids) or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level vocabulary whose ids follow its merges")
        import tiktoken

        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else lambda s: [s]
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, list[int]] = {}
        self.words = Words(lambda s: self.pack(self.core.encode_single_piece(s.encode())), lambda s: self.pack(self.core.encode_ordinary(s)), self.pack(self.core.encode_ordinary("\n")))
        self.totals = Words(self.size, lambda s: sum(map(self.size, self.find(s))), self.size("\n"))
        self.steps_of = Words(self._piece_steps, lambda s: self._steps(self._plain_prefixes(s)), self._piece_steps("\n"))

    @staticmethod
    def pack(ids) -> bytes:
        return array("I", ids).tobytes()

    # -- ids ---------------------------------------------------------------
    def ids(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers; strings of special tokens become these tokens."""
        if self.special and any(s in text for s in self.special):
            return b"".join(self.pack([self.special[p]]) if p in self.special else self._ids(p) for p in self.split(text))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _NotAlone
            return self.pack(self.core.encode_ordinary(first)) + b"".join(map(self.words.__getitem__, rest))
        except _NotAlone:
            return self.pack(self.core.encode_ordinary(text))

    # -- prefix counts -----------------------------------------------------
    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay two tokens side by side; remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.core.encode_single_piece(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Dynamic programme over one piece: entry i has the token count of its first i bytes (above bit 20) and their last token.

        The encoding of a prefix ends in exactly one token, and what stands
        before that token is the encoding of a shorter prefix.  So the last
        token is the one that reaches back to a prefix whose own last token
        it doesn't merge with.  The entries of a piece's first bytes are
        remembered, as pieces share them.
        """
        head = piece[:HEAD]
        known = self.known.get(head)
        if known is None:
            known = self._extended([0], head)
            if len(self.known) >= HEADS:
                self.known.clear()
            self.known[head] = known
        return known if len(piece) <= HEAD else self._extended(known[:], piece)

    def _extended(self, out: list[int], piece: bytes) -> list[int]:
        """out, the entries of a start of piece, with those of the rest."""
        ranks, pairs, fits = self.ranks.get, self.pairs.get, self.fits
        for end in range(len(out), len(piece) + 1):
            start = end - 1
            while True:
                token = ranks(piece[start:end])
                if token is not None:
                    if not start:
                        out.append(1 << 20 | token)
                        break
                    left = out[start]
                    last = left & 0xFFFFF
                    stay = pairs(last << 20 | token)
                    if stay is None:
                        stay = fits(last, token)
                    if stay:
                        out.append((left >> 20) + 1 << 20 | token)
                        break
                start -= 1
        return out

    def size(self, piece: str) -> int:
        """Token count of a whole piece."""
        return self.prefixes(piece.encode())[-1] >> 20

    def table(self, piece: str) -> list[int]:
        """Token counts of a piece's prefixes, one for each number of characters."""
        states = self.prefixes(piece.encode())
        if len(states) == len(piece) + 1:
            return [s >> 20 for s in states]
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(states[at] >> 20)
        return out

    def total(self, text: str) -> int:
        """Token count of a whole text: the last entry of its prefix counts."""
        if self.special and any(s in text for s in self.special):
            return sum(1 if p in self.special else self._total(p) for p in self.split(text))
        return self._total(text)

    def _total(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _NotAlone
            return sum(self.size(p) for p in self.find(first)) + sum(map(self.totals.__getitem__, rest))
        except _NotAlone:
            return sum(map(self.size, self.find(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Entry i: the number of tokens of text[:i], encoded alone; len(text) + 1 entries."""
        out = [0]
        for part in self.split(text) if self.special else [text]:
            base = out[-1]
            if part in self.special:
                head = self._plain_prefixes(part)
                out += [base + x for x in head[1:-1]] + [base + 1]
            else:
                out += [base + x for x in self._plain_prefixes(part)[1:]]
        return out

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return array("b", map(sub, counts[1:], counts)).tobytes()

    def _piece_steps(self, piece: str) -> bytes:
        if piece.isascii():
            states = self.prefixes(piece.encode())
            return array("b", [(b >> 20) - (a >> 20) for a, b in pairwise(states)]).tobytes()
        return self._steps(self.table(piece))

    def steps(self, text: str) -> bytes:
        """The table of prefix counts as differences, a signed byte for each character: the count of text[:i] is the sum of the first i.

        No step leaves a byte's range: one more character adds a token for
        each of its bytes at most, and what it can merge away are the tokens
        of one entry of the vocabulary; should a vocabulary have an entry that
        long, this raises OverflowError.
        """
        if not text:
            return b""
        if not (self.special and any(s in text for s in self.special)):
            first, *rest = text.split(" ")
            if first and not first[-1].isspace():
                try:
                    return self._steps(self._plain_prefixes(first)) + b"".join(map(self.steps_of.__getitem__, rest))
                except _NotAlone:
                    pass
        return self._steps(self.prefix_counts(text))

    def _plain_prefixes(self, text: str) -> list[int]:
        out, base, run = [0], 0, None
        for piece in self.find(text):
            table = self.table(piece)
            for i, c in enumerate(piece, 1):
                if c.isspace():
                    # a prefix that ends in white space ends in one piece of all of it
                    if run is None:
                        whole = RUN(text, len(out) - 1)[0]
                        run = iter([out[-1] + x for x in self.table(whole)[1:]])
                    out.append(next(run))
                else:
                    run = None
                    short = piece[0] == "'" and i == 2 < len(piece) and piece[1].isalpha()
                    out.append(base + (self.size("'") + self.size(piece[1]) if short else table[i]))
            base += table[-1]
            # the count after a piece is what the longer text has there
            if not piece[-1].isspace():
                out[-1] = base
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        return fit(self.steps(text), budget)


def counts(steps: bytes) -> np.ndarray:
    """Token count of every prefix, the empty one first, from its differences."""
    out = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(np.frombuffer(steps, np.int8), out=out[1:], dtype=np.int64)
    return out


def fit(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens (-1: not even the empty one); found from the end, so that a long text is summed once."""
    return int(np.flatnonzero(counts(steps) <= budget)[-1]) if budget >= 0 else -1


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each worker process and file."""
    return Bpe(path)
