"""Document fingerprints by SpotSigs.

A spot signature is a common word (the anchor) with the chain of content words that follow it; a
fingerprint is the sorted multiset of a text's hashed signatures. Fingerprints are parted by set length
and compared by a Jaccard similarity that stops where the lengths rule the wanted likeness out.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from captionloom.llm.common import map_columns, prepare, scratch

CHAIN = 2

#: Documents in a stretch that one task sorts.
STRETCH = 10_000

#: At most so many stretches; beyond that they grow, and are sorted on disk.
STRETCHES = 10_000

#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his if in into is it its no not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur tout un une vous y "
    "aber als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer er es für hat ich ihr im ist man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "al algo como con cuando del donde el ella ellos era esta este esto fue ha hay las lo los me mi muy más o para pero por porque qué según ser si sin sobre su sus también te tiene todo tu ya yo".split()
)

_WORD = re.compile(r"[^\W_]+")
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Hasher(dict):
    """word -> 64-bit hash whose last bit tells anchors; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self[word] = h = h | 1 if word in ANCHORS else h & ~1
        return h


def signatures(text: str | None, hasher: Hasher, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures.

    The start of a text is an anchor too, with chains of every length up to `chain`, so that each text
    with a content word has a signature; a chain cut off by the text's end is kept. Texts with
    anchors alone have their anchors for signatures, texts without a word have one of the whole text,
    null and empty texts none.
    """
    if not text:
        return np.zeros(0, np.uint32)
    words = _WORD.findall(text.lower())
    if not words:
        return np.frombuffer(hashlib.blake2b(text.encode(), digest_size=4).digest(), "<u4")
    h = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
    common = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~common)
    if not len(content):
        return np.unique((h * _PLACE[0]) >> np.uint64(32)).astype("<u4")
    spots = np.flatnonzero(common)
    at = np.searchsorted(content, spots)
    spots, at = spots[at < len(content)], at[at < len(content)]
    tail = np.concatenate([h[content], np.zeros(chain, np.uint64)])
    made = h[spots] * _PLACE[0]
    for k in range(chain):
        made = made + tail[at + k] * _PLACE[k + 1]
    start = np.cumsum(tail[:chain] * _PLACE[1 : chain + 1])
    out = np.concatenate([made, start])
    out.sort()
    # A signature's k-th occurrence is an element of its own, so sets compare like multisets.
    k = np.arange(len(out)) - np.searchsorted(out, out)
    out += k.astype(np.uint64) * _PLACE[-1]
    out ^= out >> np.uint64(31)
    return np.unique((out * _PLACE[0]) >> np.uint64(32)).astype("<u4")


def to_text(signature: np.ndarray) -> str:
    """A fingerprint as text: base64 of its sorted signatures, four bytes each."""
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def length_class(n: int, threshold: float) -> int:
    """The set-length partition: sets more than one class apart cannot reach the threshold."""
    return int(math.log(max(1, n)) / -math.log(threshold)) if threshold < 1 else n


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints if it reaches the threshold, else 0. Two empty ones are alike.

    Without a threshold it is exact. With one:

    Sets of partitions that are no neighbours are not compared. The others are, in ranges of values: what
    is common so far and the smaller rest of each range bound the overlap, and the comparison stops once
    that is less than the threshold takes.
    """
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if threshold and (not small or abs(length_class(small, threshold) - length_class(large, threshold)) > 1):
        return 0.0
    wanted = threshold / (1 + threshold) * (small + large) - 1e-9
    parts = min(8, 1 + large // 256)
    edges = np.array([k * (1 << 32) // parts for k in range(1, parts)], np.uint64)
    at, bt = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (a, b))
    rest = np.minimum(np.diff(at), np.diff(bt))
    both, open_ = 0, int(rest.sum())
    for k in range(parts):
        if both + open_ < wanted:
            return 0.0
        open_ -= int(rest[k])
        if rest[k]:
            both += len(np.intersect1d(a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]], assume_unique=True))
    return both / (small + large - both) if both >= wanted else 0.0


def like_fingerprints(docs: DataFrame, queries: Column, threshold: float = 0.8) -> DataFrame:
    """(doc_id, other_id, likeness): for each row that `queries` selects, all other rows at least so like it.

    Texts of one fingerprint are one class, searched for once. Classes are keyed by the partition of their
    set length and by the signatures of which two like sets must share one: the first n - ceil(t n) + 1 in
    order. A query looks into its own partition and both neighbours; what it meets is compared by
    likeness(). Rows without doc_id take no part; two empty fingerprints are alike; an empty table
    gives none.
    """
    made = scratch(fingerprints(docs.filter("doc_id is not null").withColumn("_asks", F.coalesce(queries, F.lit(False))), "_asks"), "fingerprints")
    classes = made.groupBy("fingerprint").agg(F.max("_asks").alias("asks"))

    def keys():
        def f(fingerprint, asks):
            out = [[], [], [], []]
            for text, ask in zip(fingerprint, asks, strict=True):
                x = from_text(text)
                own = length_class(len(x), threshold)
                first = x[: len(x) - math.ceil(threshold * len(x) - 1e-9) + 1].tolist() or [-1]
                for role, near in ((False, (own,)), *([(True, (own - 1, own, own + 1))] if ask else [])):
                    for p in near:
                        for c, v in zip(out, ([text] * len(first), [p] * len(first), first, [role] * len(first)), strict=True):
                            c.extend(v)
            return out

        return f

    keyed = scratch(map_columns(classes, keys, "fingerprint string, part int, signature long, asks boolean"), "signatures")
    asked = keyed.filter("asks").select(F.col("fingerprint").alias("asked"), "part", "signature")
    met = keyed.filter("not asks").select("fingerprint", "part", "signature").join(asked, ["part", "signature"]).select("asked", "fingerprint").distinct()

    def compare():
        return lambda asked, fingerprint: [asked, fingerprint, [likeness(from_text(a), from_text(b), threshold) for a, b in zip(asked, fingerprint, strict=True)]]

    like = map_columns(met, compare, "asked string, fingerprint string, likeness double").filter(F.col("likeness") >= threshold)
    found = like.join(made.filter("_asks").select("doc_id", F.col("fingerprint").alias("asked"), F.col("row").alias("_a")), "asked").join(made.select(F.col("doc_id").alias("other_id"), "fingerprint", F.col("row").alias("_b")), "fingerprint")
    return found.filter("_a != _b").select("doc_id", "other_id", "likeness")


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, n_signatures, fingerprint) of each whole text; repeated rows get equal ones, an empty table none.

    With boolean columns to `carry`, these and `row`, a number of the row, come too.
    """

    def make():
        hasher = Hasher()

        def f(doc, text, *more):
            made = [signatures(t, hasher) for t in text]
            return [doc, [len(m) for m in made], [to_text(m) for m in made], *more]

        return f

    got = map_columns(docs.select("doc_id", "text", *carry), make, "".join(["doc_id long, n_signatures long, fingerprint string", *[f", {c} boolean" for c in carry]]))
    return got.withColumn("row", F.monotonically_increasing_id()) if carry else got


def with_neighbours(docs: DataFrame, fn, schema: str) -> DataFrame:
    """fn(doc_id, text, next text) -> row, next being the following document by descending doc_id, null last.

    After the last comes the first. Documents are dealt in stretches of doc_id and sorted there; the
    head of each stretch is also sent, as a sentinel, to the end of the stretch before it. Rows with
    equal doc_id follow each other in order of their texts' hashes. Null texts are empty; an empty table
    gives none. Rows of one doc_id, and those without, are one stretch.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.count()
    n = min(STRETCHES, max(2 * spark.sparkContext.defaultParallelism, -(-rows // STRETCH)))
    cuts = docs.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if rows else []
    cuts = np.unique(np.array(cuts, np.int64))
    dealt = _deal(docs.select("doc_id"), cuts, None)
    # A row for each stretch: which there are, and their first doc_id; at most STRETCHES.
    heads = {r["stretch"]: r["head"] for r in dealt.groupBy("stretch").agg(F.max("doc_id").alias("head")).collect()}
    every = _deal(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cuts, heads).withColumn("tie", F.xxhash64("text"))
    # One stretch a partition: dealt by a hash, several would meet in one.
    ordered = every.repartitionById(len(cuts) + 1, "stretch").sortWithinPartitions("stretch", "sentinel", F.col("doc_id").desc_nulls_last(), "tie").select("stretch", "sentinel", "doc_id", "text")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = fn()
        last = None
        for b in batches:
            made = []
            for s, sentinel, doc, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if last is not None and last[0] == s:
                    made.append(work(last[1], last[2], text))
                last = None if sentinel else (s, doc, text)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t.type) for k, t in enumerate(arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _deal(rows: DataFrame, cuts: np.ndarray, heads: dict[int, int | None] | None) -> DataFrame:
    """rows with `stretch` (0 for the largest doc_id, null in the last) and `sentinel`; with `heads`, sentinels are added."""
    there = sorted(heads or {})
    to = {s: there[k - 1] for k, s in enumerate(there)}
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, stretch int, sentinel boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            doc = b.column(0)
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
            stretch = np.where(null, len(cuts), len(cuts) - np.searchsorted(cuts, ids, side="right")).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stretch), pa.array(np.zeros(len(doc), bool))], schema=arrow)
            if heads:
                first = [k for k, (s, d, gone) in enumerate(zip(stretch.tolist(), ids.tolist(), null.tolist(), strict=True)) if heads[s] == (None if gone else d)]
                if first:
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in b.columns], pa.array([to[int(stretch[k])] for k in first], pa.int32()), pa.array([True] * len(first))], schema=arrow)

    return rows.mapInArrow(run, schema)


def edit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document's; likeness is exact, however small. Null texts are empty ones; equal texts have equal
    fingerprints; equal doc_ids follow each other in order of their texts' hashes, nulls come last; an
    empty table gives none; other columns are left out.
    """

    def make():
        hasher = Hasher()
        kept: list = [None, None]  # the next document's signatures are needed again as its own

        def own(text):
            if kept[0] != text:
                kept[:] = text, signatures(text, hasher)
            return kept[1]

        def work(doc, text, following):
            n = len(text)
            cut = n // 3
            edited = text[: n - cut] + following[:cut]
            a, e, b = own(text), signatures(edited, hasher), own(following)
            return doc, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(a), to_text(e), likeness(a, e), likeness(a, b)

        return work

    return with_neighbours(docs, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
