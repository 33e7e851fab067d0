"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Byte-owner arrays: each tokenizer's token indices are repeated over the bytes they cover. Consecutive
distinct pairs of owners are the overlaps of tokens (links); where both owners change at once, both
tokenizers end a token, which cuts the text into groups.

Neither tokenizer joins what stands before a space to the space if the character before is no white
space, and every such place is a cut of both. So a text falls into units (a space and what follows),
which a worker aligns once, many at a time, and remembers. Unlike texts, units are short and repeat.

Links are counted over the corpus by (A id, B id), a table that the two vocabularies bound, and joined
back to each document's distinct pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from captionloom.llm.common import prepare, scratch

#: Units that a worker remembers, and their characters, before it forgets them all.
UNITS = 300_000
UNIT_CHARS = 16 << 20

#: Characters of a text that are looked at together.
WINDOW = 1 << 20

#: Pairs of ids (some tens of bytes each) that are sent to every executor; more are joined by shuffling.
BROADCAST_PAIRS = 2_000_000

#: A place where a unit may begin: before a space, after a character that no table of Unicode calls white space.
_CUT = re.compile(r"(?<=[^\s᠎])(?= )")
_WHITE_RUN = re.compile(r"[\s᠎][\s᠎]")


def byte_spelling() -> dict[str, int]:
    """The character by which byte-level files spell a byte -> the byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut where units may begin."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def units(piece: str) -> list[str]:
    """The units of a piece, which begins with a space or where a unit does."""
    if piece[:1] == " " and not _WHITE_RUN.search(piece):
        return [" " + w for w in piece[1:].split(" ")]
    return _CUT.split(piece)


class Aligner:
    """Aligns units by a byte-level tokenizers file (A) and a sentencepiece model with byte fallback (B).

    `numbers` has a row for each known unit: tokens of A and B, groups, links, 1 if a tokenizer's bytes
    differ from the unit's. A link is the code A id * size of B + B id.
    """

    def __init__(self, path_a: str, path_b: str, keep: int = UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelling = byte_spelling()
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in special else bytes(spelling[c] for c in token)
        self.size_b, self.space_b = self.b.get_piece_size(), self.b.piece_to_id("▁")
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        if any(re.search(r"[^▁]▁", p) for _, p in pieces) or "".join(self.b.encode("x  y", out_type=str)) != "▁x▁▁y":
            raise ValueError(f"{path_b} joins words, or does not keep white space")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = (np.array([f"{i}{after}" for after in marks for i in range(len(t))], object) for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;\n")))
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.numbers = np.zeros((0, 5), np.int64)
        self.groups: list[bytes] = []
        self.codes, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Align units not known yet, all at once."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # The model adds the space, but not to an empty text.
        ids_b = [ids or [self.space_b] for ids in self.b.encode([u[1:] for u in new], num_threads=1)]
        raw = [u.encode() for u in new]
        right = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        good = np.flatnonzero(right)
        numbers = np.zeros((len(new), 5), np.int64)
        numbers[:, 4] = ~np.array(right, bool)
        numbers[good, 0], numbers[good, 1] = [len(ids_a[k]) for k in good], [len(ids_b[k]) for k in good]
        flat_a, flat_b = (np.array([i for k in good for i in ids[k]], np.int64) for ids in (ids_a, ids_b))
        groups, codes = [b""] * len(new), np.zeros(0, np.int64)
        if len(flat_a):
            size = np.array([len(raw[k]) for k in good], np.int64)
            owner_a, owner_b = (np.repeat(np.arange(len(flat)), lengths[flat]) for flat, lengths in ((flat_a, self.length_a), (flat_b, self.length_b)))
            moved_a, moved_b = (np.concatenate([[True], o[1:] != o[:-1]]) for o in (owner_a, owner_b))
            link, cut = np.flatnonzero(moved_a | moved_b), np.flatnonzero(moved_a & moved_b)
            codes = flat_a[owner_a[link]] * self.size_b + flat_b[owner_b[link]]
            ends = np.cumsum(size)
            numbers[good, 2], numbers[good, 3] = (np.diff(np.searchsorted(at, ends), prepend=0) for at in (cut, link))
            # Each token's name, then what follows it: a comma within a side of a group, a bar, a semicolon or, after a unit, a line's end.
            group = np.cumsum(moved_a & moved_b) - 1
            group_a, group_b = (group[np.cumsum(lengths[flat]) - lengths[flat]] for flat, lengths in ((flat_a, self.length_a), (flat_b, self.length_b)))
            last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
            after_b = last_b.astype(np.int64)
            after_b[np.cumsum(numbers[good, 1]) - 1] = 2
            named = np.concatenate([self.names_a[flat_a + len(self.bytes_a) * last_a], self.names_b[flat_b + self.size_b * after_b]])
            written = "".join(named[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()).encode().split(b"\n")
            for k, line in zip(good.tolist(), written, strict=False):  # nothing follows the last line's end
                groups[k] = line
        self.index.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(numbers[:, 3])])
        self.numbers = np.concatenate([self.numbers, numbers])
        self.groups += groups
        self.codes = np.concatenate([self.codes, codes])

    def look(self, found: list[list[str]]) -> list[np.ndarray]:
        """The numbers of units, list by list; what is not known yet is learned at once."""
        new = [u for u in dict.fromkeys(chain.from_iterable(found)) if u not in self.index]
        if len(self.index) + len(new) > self.keep or self.chars > UNIT_CHARS:
            self.forget()
            new = list(dict.fromkeys(chain.from_iterable(found)))
        if new:
            self.learn(new)
        return [np.fromiter(map(self.index.__getitem__, x), np.int64, len(x)) for x in found]

    def links(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes of units (by number, repeats counted), ascending, and how often each stands."""
        kinds, times = np.unique(at, return_counts=True)
        n = self.numbers[kinds, 3]
        flat = np.repeat(self.ends[kinds], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes, back = np.unique(self.codes[flat], return_inverse=True)
        return codes, np.bincount(back, np.repeat(times, n), len(codes)).astype(np.int64)

    def align(self, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """For each text its numbers (tokens of A and B, groups, links), the digest of its groups, codes and their counts."""
        totals, digests = np.zeros((len(texts), 5), np.int64), [hashlib.sha256() for _ in texts]
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]

        def take(pieces: list[tuple[int, str]]) -> None:
            for (k, _), at in zip(pieces, self.look([units(p) for _, p in pieces]), strict=True):
                totals[k] += self.numbers[at].sum(axis=0)
                if parts[k]:
                    digests[k].update(b";")
                digests[k].update(b";".join(map(self.groups.__getitem__, at.tolist())))
                parts[k].append(self.links(at))

        held, chars = [], 0
        for k, text in enumerate(texts):
            for piece in windows(" " + text) if text else ():
                held.append((k, piece))
                chars += len(piece)
                if chars > WINDOW:
                    take(held)
                    held, chars = [], 0
        take(held)
        nothing = np.zeros(0, np.int64)
        out = []
        for total, digest, found in zip(totals.tolist(), digests, parts, strict=True):
            if total[4] or not found:
                out.append(([0, 0, 0, 0], "", nothing, nothing))
                continue
            codes, counts = found[0]
            if len(found) > 1:
                codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)
            out.append((total[:4], digest.hexdigest(), codes, counts))
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links): each text's tokens, groups and distinct linked ids.

    `row` tells rows apart; `links` are (a, b, n times). Null and empty texts, and those that a
    tokenizer does not give back, have no tokens, no links and '' for the digest. Texts are read in
    windows, however long; repeated rows are alike; an empty table gives none; further columns are ignored.
    """
    prepare(docs.sparkSession)
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a: int, b: int, n: int>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        made, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            got = made.align(b.column(1).to_pylist())
            numbers = np.array([g[0] for g in got], np.int64)
            codes, counts = (np.concatenate([g[k] for g in got]) for k in (2, 3))
            ends = np.cumsum([0, *(len(g[2]) for g in got)])
            item = arrow.field("links").type.value_type
            links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (codes // made.size_b, codes % made.size_b, counts)], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), links, type=arrow.field("links").type)
            columns = [pa.array(np.arange(row, row + len(got))), b.column(0), *[pa.array(numbers[:, k]) for k in range(4)], pa.array([g[1] for g in got], pa.string()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            row += len(got)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many rows hold the pair linked, and whether no other pair of the A id has more.

    links: (a, b), one row for each row and distinct pair. The two vocabularies bound the result.
    """
    counted = links.groupBy("a", "b").agg(F.count("*").alias("docs"))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each A id
    return counted.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of docs; see aligned().

    `count_sum` sums the corpus-wide counts of the row's links, `n_best` counts the links whose count is
    the highest of their A id.
    """
    rows = scratch(aligned(docs, path_a, path_b), "aligned")
    links = rows.select("row", F.inline("links"))
    pairs = scratch(pair_counts(links.select("a", "b")), "linked-ids")
    known = F.broadcast(pairs) if pairs.count() <= broadcast_pairs else pairs
    sums = links.join(known, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    with_sums = rows.drop("links").join(sums, "row", "left")
    return with_sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
