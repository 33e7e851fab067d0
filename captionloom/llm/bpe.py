"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that an automaton over strings finds every vocabulary
entry in a piece of text. A piece is encoded by taking the longest match at each place and stepping
back to the next shorter prefix whenever two neighbours could not stand next to each other after the
merges were applied in rank order. Whether two ids are compatible is memoised. The result equals the
merges' result, in time linear in the piece. Texts with characters that tiktoken classes otherwise than
`regex` does are split with stand-ins of tiktoken's classes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from captionloom.llm.common import map_columns

#: Pieces remembered by a worker; the memory is emptied when full, so it is bounded.
PIECES = 400_000

#: Pairs of neighbours whose compatibility a worker remembers.
PAIRS = 1_000_000

#: Fixed value: the public pre-split pattern for which texts can be cut at single spaces.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE_RUN = regex.compile(r" \s| \Z")


#: The classes of characters that a pattern may name.
_CLASS = regex.compile(r"\\[pP]\{\^?\w+\}|\\[sSwWdD]")
_CHARACTERS = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)


@lru_cache(maxsize=4)
def stand_ins(pattern: str) -> dict[int, str]:
    """code point -> a character that `regex` classes as tiktoken classes the code point, where the two differ.

    The two know different versions of Unicode. An encoder of single bytes whose pattern is one class
    keeps just the members of the class, which gives tiktoken's tables.
    """
    single = {bytes([k]): k for k in range(256)}
    theirs, ours = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for k, name in enumerate(sorted(set(_CLASS.findall(pattern)))):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        for table, members in ((theirs, library.decode(library.encode_ordinary(_CHARACTERS))), (ours, "".join(regex.findall(name, _CHARACTERS)))):
            table[np.frombuffer(members.encode("utf-32-le"), "<u4")] += 1 << k
    agreed = {int(theirs[c]): chr(c) for c in np.flatnonzero(theirs == ours)[::-1] if 0xA0 < c < 0xD800 and chr(c) not in pattern}
    return {int(c): agreed[int(theirs[c])] for c in np.flatnonzero(theirs != ours)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memo(dict):
    """A dict that fills itself by `make` and, when full, keeps its short keys: those are the frequent ones."""

    def __init__(self, make, most: int = PIECES, short: int = 8, longest: int = 256):
        super().__init__()
        self.make, self.most, self.short, self.longest = make, most, short, longest

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                for k in [k for k in self if len(k) > self.short]:
                    del self[k]
                if len(self) >= self.most // 2:
                    self.clear()
            self[key] = made
        return made


class Codec:
    """Encoder and decoder for one vocabulary. Results are ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.words = {i: b for b, i in ranks.items()}
        self.rank = ranks
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.pieces = Memo(lambda piece: np.array(self.tokens(piece.encode()), "<u4").tobytes())
        join = lambda text: b"".join(map(self.pieces.__getitem__, self.split(text)))
        self.join = join
        #: By what follows a single space, that space included in the result.
        self.after_space = Memo(lambda rest: join(" " + rest))
        self.by_space = pattern == SPACE_LED
        self.stand_ins = stand_ins(pattern)
        self.odd = np.zeros(0x110000, bool)
        self.odd[list(self.stand_ins)] = True
        self.spans = regex.compile(pattern).finditer

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two ids whose merge makes the token last; None for one that no merge makes."""
        if token not in self.halves:
            word = self.words[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
                if best[0] >= token:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ok = len(parts) == 2 and all(p in self.rank for p in parts)
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if ok else None
        return self.halves[token]

    def next_shorter(self, token: int) -> int:
        """The longest id that is a proper prefix of the token; -1 if there is none."""
        if token not in self.shorter:
            word = self.words[token]
            self.shorter[token] = next((self.rank[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.rank), -1)
        return self.shorter[token]

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            joined = self.rank.get(self.words[a] + self.words[b])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two outer merges: until then, its inner half was the neighbour.
            # At equal ranks the leftmost pair merges first: the join comes after a's, before b's.
            x, y = self.halves_of(a), self.halves_of(b)
            if x is not None and (y is None or a > b):
                limit, a = a, x[1]
            elif y is not None:
                limit, b = b + 1, y[0]
            else:
                return True

    def tokens(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None and (len(piece) == 1 or self.halves_of(whole) is not None):
            return [whole]
        n, length, fits = len(piece), self.length, self.fits
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, left = 0, longest[0], -1
        while True:
            if token < 0:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                left = out[-1] if out else -1
            else:
                end = at + length[token]
                if not dead[end]:
                    good = True
                    if left >= 0:
                        key = left << 32 | token
                        good = fits.get(key)
                        if good is None:
                            if len(fits) >= PAIRS:
                                fits.clear()
                            good = fits[key] = self._compatible(left, token)
                    if good:
                        out.append(token)
                        if end == n:
                            return out
                        at, left, token = end, token, longest[end]
                        continue
            token = self.next_shorter(token)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null is an empty text.

        Under SPACE_LED no match crosses from another character to a space, and a space is never seen by
        the match before it, so a text without a space before white space may be cut at its spaces.
        """
        if not text:
            return b""
        if not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            cuts = self.spans(text.translate(self.stand_ins))
            return b"".join([self.pieces[text[m.start() : m.end()]] for m in cuts])
        if not self.by_space or _SPACE_RUN.search(text):
            return self.join(text)
        first, *rest = text.split(" ")
        return b"".join([self.join(first), *map(self.after_space.__getitem__, rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its whole text as `ids array<int>`.

    Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives none;
    further columns are left out.
    """

    def make():
        c = codec(path, pattern)
        return lambda doc, text: [doc, [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in text]]

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of `ids`; null ids are an empty text; bytes that are no UTF-8 become U+FFFD.

    Repeated rows are decoded each; an empty table gives none; texts of any length are one row's memory.
    """

    def make():
        c = codec(path, pattern)
        return lambda doc, ids: [doc, [c.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in ids]]

    return map_columns(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the ids, SHA-256 of the bytes decoded from them.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table gives none;
    texts are encoded whole, in time linear in their length; further columns are left out.
    """

    def make():
        c = codec(path, pattern)

        def f(doc, text):
            coded = [c.encode(t) for t in text]
            digest = lambda b: hashlib.sha256(b).hexdigest()
            return [doc, [len(b) // 4 for b in coded], [digest(b) for b in coded], [digest(c.decode(b)) for b in coded]]

        return f

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
