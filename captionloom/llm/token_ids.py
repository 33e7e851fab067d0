"""Token ids as files: frequency-ranked ids, 1 to 4 bytes each, control bytes kept apart.

Layout of a written corpus (a folder):

* `ranks/`: (rank, id), the ids in order of falling count over the whole corpus, ties by id.
* `blocks/`: one row for each block of documents. Documents ascend by doc_id within a shard, shards
  ascend by doc_id. `first` counts the ids of the shard before the block, `control` has two bits a
  value (its bytes less one, four values a byte, low bits first), `data` the values' little-endian
  bytes without leading zeros.

Values are ranks, so frequent ids take one byte. Parquet is the container: its committer makes every
file appear whole or not at all, whichever executors are lost.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionloom.llm.bpe import _SPACE_RUN, SPACE_LED, Memo
from captionloom.llm.common import map_columns, prepare, scratch, scratch_folder

END_ID = 2

#: Ids in a shard; a shard is what one task sorts and writes.
SHARD_IDS = 16_000_000

#: Code points that may be characters of classes, private use apart.
ODD_END = 0x40000

#: Characters before it are letters in every version of Unicode, if in one.
LATIN_END = "\u0250"

#: Stretches of text, and pieces, that a worker remembers the ids of.
STRETCHES = 900_000

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_PLACES = np.arange(4, dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    lens = np.ones(len(v), np.uint8)
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        lens += v > bound
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = lens - 1
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[_PLACES < lens[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack(), by table lookup of the control bytes."""
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_PLACES < lens[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


@lru_cache(maxsize=1)
def odd_characters() -> bytes:
    """A bit for each code point below ODD_END: whether the tokenizers library classes it otherwise than `regex` does.

    Beyond are private use and planes without characters.
    """
    from tokenizers import Regex, pre_tokenizers

    odd, every = np.zeros(ODD_END, bool), "".join(chr(c) for c in range(ODD_END) if not 0xD800 <= c <= 0xF8FF)
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        left = pre_tokenizers.Split(Regex(f"{name}+"), behavior="removed").pre_tokenize_str(every)
        odd[np.frombuffer("".join(p for p, _ in left).encode("utf-32-le"), "<u4")] ^= True
        odd[np.frombuffer("".join(regex.findall(name, every)).encode("utf-32-le"), "<u4")] ^= True
        odd[np.frombuffer(every.encode("utf-32-le"), "<u4")] ^= True
    return np.packbits(odd).tobytes()


def space_led(path: str) -> bool:
    """Whether a tokenizers file is plain byte-level BPE: no normalizer, the SPACE_LED split over bytes, merges alone."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    off = [file.get("normalizer"), file.get("truncation"), file.get("padding"), *[model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]]
    return not any(off) and model.get("type") == "BPE" and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)


class LibraryEncoder:
    """Encodes texts with a tokenizers file, asking the library's model once for each distinct piece.

    Where the file's pre-split is SPACE_LED over bytes, texts can be cut at single spaces (see
    bpe.Codec.encode), and stretches and pieces already seen are looked up. The library gets whole texts
    of any other file, those that hold an added token's string, and those with a character of `odd`,
    which it splits after tables of its own.
    """

    def __init__(self, path: str, odd: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.plain = space_led(path)
        self.odd = np.unpackbits(np.frombuffer(odd, np.uint8)).astype(bool)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPACE_LED).findall
        # Byte-level files spell bytes as printable characters: those that are so already, then the rest from 256 on.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(printable)]
        spelling = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        ask, space = self.library.model.tokenize, spelling[32]

        def ids(spelled: str) -> bytes:
            return array("I", [t.id for t in ask(spelled)]).tobytes()

        def of_piece(piece: str) -> bytes:
            return ids(piece.encode().decode("latin-1").translate(spelling))

        def of_stretch(rest: str) -> bytes:
            # A word of letters is one piece, which is spelled as it is but for the space; a mark after
            # it is another. Anything else is split.
            if rest.isascii():
                if rest.isalpha():
                    return ids(space + rest)
                if rest[:-1].isalpha() and rest[-1] in ",.;:!?":
                    return self.after_space[rest[:-1]] + self.pieces[rest[-1]]
            elif rest.isalpha() and max(rest) < LATIN_END:
                return of_piece(" " + rest)
            return self.join(" " + rest)

        self.pieces, self.after_space = Memo(of_piece, STRETCHES), Memo(of_stretch, STRETCHES)
        look = self.pieces.__getitem__
        self.join = lambda text: b"".join(map(look, self.split(text)))

    def whole(self, text: str) -> bool:
        """Whether the library must see the text as a whole."""
        if not self.plain or any(s in text for s in self.special):
            return True
        if text.isascii():
            return False
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return bool(self.odd[points[points < ODD_END]].any())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as unsigned 32-bit bytes; null is an empty text."""
        out, look = [], self.after_space.__getitem__
        for t in texts:
            if not t:
                out.append(b"")
            elif self.whole(t):
                out.append(array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes())
            elif _SPACE_RUN.search(t):
                out.append(self.join(t))
            else:
                first, *rest = t.split(" ")
                out.append(b"".join([self.join(first), *map(look, rest)]))
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str, odd: bytes) -> LibraryEncoder:
    return LibraryEncoder(path, odd)


def encode_with_library(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and `ids` (zstd of unsigned 32-bit ids, the end id last) of each whole text.

    Null and empty texts have the end id alone; repeated rows are encoded each; an empty table gives none;
    further columns are left out.
    """
    odd = odd_characters()

    def make():
        encoder, squeeze, end = library_encoder(path, odd), zstandard.ZstdCompressor(level=1), np.array([end_id], "<u4").tobytes()
        # Two-byte ids squeeze better; four bytes where the vocabulary needs them.
        kind = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"

        def f(doc, text):
            ids = [np.frombuffer(b + end, "<u4") for b in encoder.encode(text)]
            return [doc, [len(x) for x in ids], [squeeze.compress(x.astype(kind).tobytes()) for x in ids]]

        return f

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids binary")


def _raw(ids: list[bytes], counts: list[int]) -> np.ndarray:
    """All ids of a batch, one after the other."""
    widen = zstandard.ZstdDecompressor()
    parts = [widen.decompress(x) for x in ids]
    return np.concatenate([np.frombuffer(p, "<u2" if len(p) == 2 * n else "<u4").astype("<u4") for p, n in zip(parts, counts, strict=True)] or [np.zeros(0, "<u4")])


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus; each task sums before it sends. Repeated rows count each; an empty table gives none."""
    prepare(encoded.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(_raw(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], schema=schema)

    return encoded.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> str:
    """Encode every whole text, rank the ids by frequency and write the corpus to `folder`.

    Null and empty texts are the end id alone; documents with equal or null doc_id stay apart (null
    first, equal ones in one shard in order of a hash of their ids, so that reruns agree); an empty
    table writes a corpus of no blocks; further columns are ignored.
    """
    spark = docs.sparkSession
    encoded = scratch(encode_with_library(docs, path, end_id), "encoded")
    # One row for each id in use: bounded by the vocabulary.
    ranked = [r["id"] for r in id_counts(encoded).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(r, i) for r, i in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max([0, *ranked]) + 1, "<u4")
    rank[ranked] = np.arange(len(ranked), dtype="<u4")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    schema = "shard long, block long, first long, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"
    arrow = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def blocks(batches):
        shard, first = TaskContext.get().partitionId(), 0
        for k, b in enumerate(batches):
            doc, counts, ids = (b.column(i).to_pylist() for i in range(3))
            control, data = pack(rank[_raw(ids, counts)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([shard], [k], [first], [doc], [counts], [control], [data]), arrow, strict=True)], schema=arrow)
            first += sum(counts)

    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_IDS))
    (
        encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
        .select("doc_id", "n_tokens", "ids")
        .mapInArrow(blocks, schema)
        .write.option("compression", "zstd")
        .parquet(f"{folder}/blocks")
    )
    return folder


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): each document's ids as little-endian unsigned 32-bit bytes.

    `start` counts the ids of all documents before it in the corpus. A row for each document written,
    repeated and null doc_ids too; a corpus of no blocks gives none.
    """
    return _read(spark, folder, "ids binary", lambda part: part.tobytes())


def corpus_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; rows as read_corpus() has them."""
    return _read(spark, folder, "ids_crc32 long", lambda part: zlib.crc32(part.tobytes()))


def _read(spark: SparkSession, folder: str, column: str, digest) -> DataFrame:
    ids = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    stored = spark.read.parquet(f"{folder}/blocks")

    def make():
        def f(shard, first, doc_ids, counts, control, data):
            out = [[], [], [], [], []]
            for s, at, docs, ns, c, d in zip(shard, first, doc_ids, counts, control, data, strict=True):
                got, here = ids[unpack(c, d, sum(ns))], 0
                for doc, n in zip(docs, ns, strict=True):
                    for column_, x in zip(out, (s, at + here, doc, n, digest(got[here : here + n])), strict=True):
                        column_.append(x)
                    here += n
            return out

        return f

    rows = map_columns(stored.select("shard", "first", "doc_ids", "counts", "control", "data"), make, f"shard long, offset long, doc_id long, n_tokens long, {column}")
    # A row for each shard, so one task can sum them up in order.
    totals = stored.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", column.split()[0])


def token_digests(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the corpus to the shared folder and return what its files hold, a row for each of docs; see write_corpus()."""
    spark = docs.sparkSession
    return corpus_digests(spark, write_corpus(docs, path, scratch_folder(spark, "tokens"), end_id))
