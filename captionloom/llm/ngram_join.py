"""Similarity join on sets of five words: MinHash bands, Bayesian pruning, exact verification.

1. Each text becomes a set of hashed word five-grams and 128 MinHash values. Texts with equal sets
   are one class, kept once with its number of copies.
2. Classes that share a band of four values meet in a bucket. A bucket's members are compared with
   the bucket's leader; only members that may not be like the leader are compared with the others,
   in blocks. A comparison reads MinHash values sixteen at a time and ends as soon as the posterior
   probability of reaching the threshold falls below the tolerance.
3. Surviving pairs span groups. Within a group every pair is pruned likewise, the rest is verified
   exactly on the sets, in blocks of bounded size, and counted where it is found: pairs are never
   emitted, only counts and the edges of a spanning forest.
4. Groups of verified links, again by connected components, give class ids.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8 and is pruned with
probability below 1e-5.
"""

from __future__ import annotations

import hashlib
import re
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import WORD, join_checked, map_columns, named, prepare, release, scratch

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-6

#: Members of a block, and shingles (8 bytes each): what one comparison holds is two blocks.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20

_WORD = re.compile(WORD)
_rng = np.random.default_rng(20240501)
_MUL = (_rng.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_PLACE = (_rng.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """word -> 64-bit hash, remembered; sets() makes a text's sorted distinct shingle hashes."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h

    def sets(self, text: str | None, k: int = SHINGLE) -> np.ndarray:
        """Texts of fewer than k words have one shingle, all their words; without a word, none."""
        words = _WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(k, len(words))
        out = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
        for j in range(size):
            out += h[j : j + len(out)] * _PLACE[j]
        return np.unique(_mix(out))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima as unsigned 32-bit values."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for s in range(0, len(shingles), 2048):  # bounds the product's size for very long texts
        part = shingles[s : s + 2048]
        out = np.minimum(out, ((part[:, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0))
    return out.astype("<u4")


def min_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... values compared: the fewest matches with posterior above tolerance.

    With a flat prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def may_reach(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """For rows of MinHash values a[i], b[i]: whether the pair survives the incremental comparison."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a x b that survive, in pieces of bounded size."""
    found = []
    for s in range(0, len(a), 64):
        i, j = np.divmod(np.arange(min(64, len(a) - s) * len(b)), len(b))
        i += s
        first = np.zeros(len(i), np.int32)
        for c in range(STEP):  # a column at a time: nothing of the size pairs x STEP is made
            first += a[i, c] == b[j, c]
        keep = first >= least[0]
        i, j = i[keep], j[keep]
        ok = may_reach(a[i], b[j], least)
        found.append((i[ok], j[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _signatures(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, HASHES)


class Forest:
    """Union-find over positions; join() says whether it merged two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, hi, lo, n, bands, sig): a 128-bit name of the shingle set, its size, band keys, MinHash values.

    The last five are null for rows without a word or without doc_id.
    """

    def make():
        shingler = Shingler()

        def f(doc, mark, text):
            out = [doc, mark, [], [], [], [], []]
            for d, t in zip(doc, text, strict=True):
                s = shingler.sets(t if d is not None else None, shingle)
                if not len(s):
                    for column in out[2:]:
                        column.append(None)
                    continue
                name = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                sig = minhash(s)
                weights = _PLACE[: BAND + 1]
                keys = (sig.reshape(-1, BAND).astype(np.uint64) * weights[:BAND]).sum(axis=1) + np.arange(HASHES // BAND, dtype=np.uint64) * weights[BAND]
                for column, x in zip(out[2:], (int(name[0]), int(name[1]), len(s), _mix(keys).view(np.int64), sig.tobytes()), strict=True):
                    column.append(x)
            return out

        return f

    return map_columns(docs.select("doc_id", "mark", "text"), make, "doc_id long, mark long, hi long, lo long, n long, bands array<bigint>, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), root the least node; nodes without edges are absent.

    Alternating large-star and small-star steps over edge rows. Minima are taken by grouping, never by
    gathering a node's neighbours, and written before they are joined, so that a node with many
    edges is no task of its own. Each round's tables are deleted when the next are written.
    """
    now = scratch(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = join_checked(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = scratch(large, "large-star")
        release(now, least)
        least = scratch(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = join_checked(large, least, ["a"])
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch(small.filter("a != b").distinct(), "small-star")
        release(large, least)
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and two exclusive ors of hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _grouped(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(columns as lists) for each run of equal keys; rows are dealt and sorted by keys first.

    Unlike a grouped map this starts no Arrow stream for each group, of which there may be millions.
    """
    prepare(rows.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns
    at = [names.index(k) for k in keys]

    def run(batches):
        held: list[list] = []
        key = None
        made: list[list] = [[] for _ in arrow]

        def flush():
            for column, x in zip(made, fn(*held), strict=True):
                column.extend(x)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, arrow, strict=True)], schema=arrow)

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            of = list(zip(*[columns[i] for i in at], strict=True))
            start = 0
            for k in range(len(of) + 1):
                if k == len(of) or of[k] != of[start]:
                    if start < k:
                        if of[start] != key:
                            if held:
                                flush()
                            held, key = [[] for _ in names], of[start]
                        for h, c in zip(held, columns, strict=True):
                            h.extend(c[start:k])
                    start = k
            if len(made[0]) >= 5000:
                yield out()
                made = [[] for _ in arrow]
        if held:
            flush()
        if made[0]:
            yield out()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) edges whose components hold every pair of reps that meets in a band and survives pruning."""
    least = min_matches(threshold)
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    # Two buckets with the same members need one visit: members are told by their hashes' exclusive or.
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("leader"), F.bit_xor(F.xxhash64("rep")).alias("members")).filter("size > 1")
    buckets = scratch(buckets.groupBy("size", "leader", "members").agg(F.min("bucket").alias("bucket")).drop("members"), "buckets")
    met = scratch(join_checked(banded, buckets, ["bucket"]), "met")
    release(buckets)
    pairs = met.filter("rep != leader").select("rep", "leader").distinct()
    sig = reps.select("rep", "sig")
    leaders = sig.select(F.col("rep").alias("leader"), F.col("sig").alias("leader_sig"))
    compared = pairs.join(sig, "rep").join(leaders, "leader").select("rep", "leader", "sig", "leader_sig")

    def check():
        return lambda rep, leader, a, b: [rep, leader, may_reach(_signatures(a), _signatures(b), least).tolist()]

    judged = scratch(map_columns(compared, check, "rep long, leader long, near boolean"), "judged")
    near = judged.filter("near").select(F.col("rep").alias("a"), F.col("leader").alias("b"))

    # Those unlike their leader, against all of the bucket.
    odd = met.filter("size > 2").join(judged.filter("not near").select("rep", "leader"), ["rep", "leader"])
    open_ = scratch(odd.groupBy("bucket").agg(F.count("*").alias("odd")), "open-buckets")
    marked = join_checked(met, open_, ["bucket"]).join(judged.filter("not near").select("rep", "leader", F.lit(True).alias("is_odd")), ["rep", "leader"], "left")
    of = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), of(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    left = marked.filter("is_odd").select("rep", "bucket", own("odd").alias("i"), all_("size").alias("j"), F.lit(True).alias("is_odd"))
    right = marked.select("rep", "bucket", all_("odd").alias("i"), own("size").alias("j"), F.lit(False).alias("is_odd"))
    shipped = left.union(right).join(sig, "rep").select("bucket", "i", "j", "rep", "is_odd", "sig")

    def compare(bucket, i, j, rep, is_odd, sigs):
        flags, s = np.array(is_odd), _signatures(sigs)
        rows, columns = np.flatnonzero(flags), np.flatnonzero(~flags)
        out_a, out_b = [], []
        if len(rows) and len(columns):
            x, y = survivors(s[rows], s[columns], least)
            place = {}
            position = [place.setdefault(r, len(place)) for r in rep]  # a member may stand on both sides
            forest = Forest(len(place))
            for p, q in zip(rows[x].tolist(), columns[y].tolist(), strict=True):
                if rep[p] != rep[q] and forest.join(position[p], position[q]):
                    out_a.append(rep[p])
                    out_b.append(rep[q])
        return out_a, out_b

    made = scratch(near.union(_grouped(shipped, ["bucket", "i", "j"], compare, "a long, b long")), "candidates")
    release(met, judged, open_)
    return made


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links, texts) from rows (root, blocks, rep, copies, shingles, sig), all pairs within a root.

    Rows with b null carry counts for a: linked documents and linked distinct texts. Rows with b are
    edges of a spanning forest of the verified links. A group's rows are dealt to its blocks and
    compared there; a group of several blocks sends each of them packed, so that what near copies
    share moves once a block and not once a row, to meet every other.
    """
    least = min_matches(threshold)

    def pairs(rep, copies, sets, p, q):
        ok = linked(sets, p, q, threshold)
        p, q = p[ok], q[ok]
        many, texts, weight = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64), np.array(copies)
        for u, v in ((p, q), (q, p)):
            np.add.at(many, u, weight[v])
            np.add.at(texts, u, 1)
        got = np.flatnonzero(texts).tolist()
        a, b, links, n = [rep[k] for k in got], [None] * len(got), many[got].tolist(), texts[got].tolist()
        forest = Forest(len(rep))
        for u, v in zip(p.tolist(), q.tolist(), strict=True):
            if forest.join(u, v):
                a.append(rep[u])
                b.append(rep[v])
                links.append(0)
                n.append(0)
        return a, b, links, n

    def within(root, own, blocks, rep, copies, shingles, sigs):
        s, sets = _signatures(sigs), [np.frombuffer(x, np.uint64) for x in shingles]
        x, y = survivors(s, s, least)
        made = [list(c) for c in pairs(rep, copies, sets, x[x < y], y[x < y])]
        size = len(made[0])
        out = [*made, [root[0]] * size, [own[0]] * size, [blocks[0]] * size, [None] * size]
        if blocks[0] > 1:
            head = np.array([rep, copies, [len(x) for x in sets]], "<i8").tobytes()
            blob = zstandard.ZstdCompressor(level=3).compress(np.int64(len(rep)).tobytes() + head + b"".join(shingles) + b"".join(sigs))
            for column, x in zip(out, (None, None, 0, 0, root[0], own[0], blocks[0], blob), strict=True):
                column.append(x)
        return out

    def between(root, i, j, own, blob):
        got = []
        for k in np.argsort(own).tolist():
            raw = zstandard.ZstdDecompressor().decompress(blob[k])
            n = int.from_bytes(raw[:8], "little")
            rep, copies, size = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
            at = 8 + 24 * n + 8 * np.concatenate([[0], np.cumsum(size)])
            sets = [np.frombuffer(raw, "<u8", m, b) for m, b in zip(size.tolist(), at.tolist(), strict=False)]
            got.append((rep.tolist(), copies.tolist(), sets, np.frombuffer(raw, "<u4", n * HASHES, int(at[-1])).reshape(n, HASHES)))
        (r1, c1, s1, m1), (r2, c2, s2, m2) = got
        x, y = survivors(m1, m2, least)
        return pairs(r1 + r2, c1 + c2, s1 + s2, x, y + len(r1))

    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).select("root", "own", "blocks", "rep", "copies", "shingles", "sig")
    first = scratch(_grouped(dealt, ["root", "own"], within, "a long, b long, links long, texts long, root long, own int, blocks int, blob binary"), "blocks")
    # Each block meets every other of its group once.
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))).alias("other")
    sent = first.filter("blob is not null").select("root", "own", other, "blob")
    sent = sent.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "blob")
    counted = first.filter("a is not null").select("a", "b", "links", "texts")
    made = scratch(counted.union(_grouped(sent, ["root", "i", "j"], between, "a long, b long, links long, texts long")), "links")
    release(first)
    return made


def linked(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Exact Jaccard test of the pairs (p, q) of sets of sorted distinct hashes."""
    size = np.array([len(s) for s in sets])
    if len(p) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
    else:
        # Many pairs: products of 0/1 matrices over stretches of the shared vocabulary.
        used = np.unique(np.concatenate([p, q]))
        every = np.concatenate([sets[k] for k in used])
        owner = np.repeat(np.arange(len(used)), size[used])
        _, code, n = np.unique(every, return_inverse=True, return_counts=True)
        keep = n[code] > 1
        code, owner = code[keep], owner[keep]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        at = np.searchsorted(used, [p, q])
        total = np.zeros((len(used), len(used)), np.float32)
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [start, start + 4096])
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[lo:hi], code[lo:hi] - start] = 1
            total += m @ m.T
        common = total[at[0], at[1]].astype(np.int64)
    union = size[p] + size[q] - common
    return common >= threshold * union - 1e-9


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row of docs as (doc_id, mark, hi, lo), and the classes that the rows belong to.

    `mark` is a hash that tells the texts under one doc_id apart. A class is a set of shingles, named
    (hi, lo): (hi, lo, copies, class_id, class_mark, links, texts), where class_id and class_mark are
    the least of the group that links make, links counts the linked rows of other classes and texts
    these classes. Rows outside all classes have hi null.
    """
    marked = docs.select("doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    all_ = scratch(sketch(marked, shingle), "sketches")
    usable = all_.filter("hi is not null")
    least = F.min(F.struct("doc_id", "mark"))
    # A class is numbered when it is written: nodes of graphs are then numbers, whatever the ids are.
    reps = usable.groupBy("hi", "lo").agg(least.alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = scratch(reps.select(F.monotonically_increasing_id().alias("rep"), "hi", "lo", "least.*", "copies", "n", "bands", "sig"), "classes")
    names = reps.select("rep", "hi", "lo", "doc_id", "mark", "copies", "n")
    edges = candidate_edges(reps, threshold)
    nodes = scratch(components(edges).withColumnRenamed("node", "rep"), "nodes")
    release(edges)
    members = nodes.join(names, "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = scratch(members.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    wanted = scratch(join_checked(members.select("rep", "root", "doc_id", "mark", "copies"), sizes, ["root"]), "groups")
    # Rows repeated under one doc_id would fetch the same text twice.
    texts = join_checked(marked, wanted, ["doc_id", "mark"]).select("rep", "root", "blocks", "copies", "text").dropDuplicates(["rep"])

    def sets():
        shingler = Shingler()

        def f(rep, root, blocks, copies, text):
            made = [shingler.sets(t, shingle) for t in text]
            return [root, blocks, rep, copies, [m.tobytes() for m in made], [minhash(m).tobytes() for m in made]]

        return f

    rows = map_columns(texts, sets, "root long, blocks int, rep long, copies long, shingles binary, sig binary")
    checked = verify(rows, threshold)
    counts = scratch(checked.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")), "counts")
    joined = scratch(components(checked.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root"), "joined")
    heads = scratch(joined.join(names, "rep").groupBy("root").agg(least.alias("head")), "heads")
    known = names.join(counts, "rep", "left").join(join_checked(joined, heads, ["root"]).drop("root"), "rep", "left")
    none, head = F.lit(0).cast("long"), F.coalesce("head", F.struct("doc_id", "mark"))
    known = scratch(known.select("hi", "lo", "copies", head["doc_id"].alias("class_id"), head["mark"].alias("class_mark"), F.coalesce("links", none).alias("links"), F.coalesce("texts", none).alias("texts")), "known")
    release(reps, nodes, sizes, wanted, checked, counts, joined, heads)
    return all_.select("doc_id", "mark", "hi", "lo"), known


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links), one row for each row of docs.

    class_id is the least doc_id of the rows joined by links, n_links the number of other rows whose
    Jaccard similarity reaches the threshold, n_text_links that of different shingle sets among them.
    Texts without a word (null, empty, blank) link to nothing; rows repeated are copies of each other;
    rows without doc_id take no part (class_id null, no links). Different texts under one doc_id are
    rows of their own, each with its own links; should they be the least of two groups, these bear the
    same class_id. An empty table gives none; other columns are left out.
    """
    rows, known = classes_of(docs, threshold, shingle)
    linked_ = rows.filter("hi is not null").join(known, ["hi", "lo"])
    linked_ = linked_.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"))
    none = F.lit(0).cast("long")
    return linked_.union(rows.filter("hi is null").select("doc_id", F.col("doc_id").alias("class_id"), none, none))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of which each group of linked rows keeps one, that of the least doc_id (then of the least hash of its text).

    Rows without doc_id or without a word belong to no group and stay, each as often as it is there.
    Further columns ride along, whatever their names; of equal rows that differ there, any one stays.
    An empty table stays empty.
    """
    rows, known = classes_of(docs, threshold)
    member = rows.filter("hi is not null").join(known.select("hi", "lo", "class_id", "class_mark"), ["hi", "lo"])
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    gone = member.filter(~stays).select("doc_id", "mark").distinct()
    again = member.filter(stays).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "mark")
    packed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.struct(*[named(c) for c in docs.columns]).alias("_row"))
    left = packed.join(gone, ["doc_id", "mark"], "left_anti")
    again = scratch(again, "repeated")
    once = left.join(again, ["doc_id", "mark"], "left_anti").union(left.join(again, ["doc_id", "mark"], "left_semi").select("doc_id", "mark", "_row").dropDuplicates(["doc_id", "mark"]))
    return once.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for similarity_join() over `documents`, whose doc_ids are unique: all pairs that share a shingle, compared exactly.
SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM worded WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(any_value(s)) AS n FROM sets GROUP BY s),
elements AS MATERIALIZED (SELECT rep, unnest(s) AS e FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM elements a JOIN elements b ON a.e = b.e AND a.rep < b.rep GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node WHERE r.root < b.b),
least AS (SELECT node AS rep, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT l.a AS rep, sum(c.copies) AS links, count(*) AS texts FROM both_ways l JOIN classes c ON c.rep = l.b GROUP BY l.a),
known AS (SELECT c.s, l.class_id, (coalesce(k.links, 0) + c.copies - 1)::BIGINT AS n_links, coalesce(k.texts, 0)::BIGINT AS n_text_links FROM classes c JOIN least l USING (rep) LEFT JOIN counts k USING (rep))
SELECT s.doc_id, k.class_id, k.n_links, k.n_text_links FROM sets s JOIN known k ON k.s = s.s
UNION ALL SELECT doc_id, doc_id, 0::BIGINT, 0::BIGINT FROM documents WHERE doc_id IS NULL OR len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) = 0
"""
