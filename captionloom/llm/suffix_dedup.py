"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

Equal strings of `least` bytes must meet in one task. Each window of that length is dealt by its
anchor, the least hash among its K-byte grams: equal windows have equal anchors. Anchors that occur
once are dropped before any text moves. Windows of one anchor occurrence are a stretch of the text (a
region); regions of a shard are put together and sorted into a suffix array, whose Burrows-Wheeler
transform is extended backwards breadth first: level L yields exactly the boundaries whose common
prefix is L, and the expansion stops at `least`. Suffixes between the boundaries left share `least`
bytes; the earliest stays.

Common grams come last in the order of anchors, so that a window with any text of its own is dealt by
that text. Windows dealt by a common gram then lie wholly inside common passages, whose equal regions
are merged before they are sent: no shard gathers a popular passage's surroundings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import give_back, map_columns, prepare, scratch

LEAST = 100
K = 24

#: Text bytes for each shard of anchors and of regions.
ANCHOR_SHARD = 32 << 20
REGION_SHARD = 8 << 20

#: Grams seen this often in a sixteenth of the documents (whatever the size, at most COMMON of them) come last.
OFTEN = 40
COMMON = 50_000

#: A null doc_id sorts after all others.
NO_ID = (1 << 63) - 1

#: Distinct regions of common grams that a task holds, some 200 bytes each.
HELD = 200_000

#: Repeated ids are looked up in memory up to this many, in a join beyond.
REPEATED = 1_000_000

_TOP = np.uint64(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
_BYTES ^= _BYTES >> np.uint64(29)

#: Window starts hashed at a time (two slabs and a window must stay below PLACES).
SLAB = 1 << 18
PLACES = 1 << 20

#: Bytes of regions that go into one suffix array.
ARRAY = 4 << 20


def grams(text: np.ndarray) -> np.ndarray:
    """63-bit hashes of all K-byte grams, by doubling."""
    power = lambda n: np.uint64(pow(int(_MUL), n, 1 << 64))
    h, size, at = _BYTES[text], 1, {}
    while True:
        at[size] = h
        if 2 * size > K:
            break
        h, size = h[:-size] * power(size) + h[size:], 2 * size
    if rest := K - size:
        h = h[: len(text) - K + 1] * power(rest) + at[rest][size : size + len(text) - K + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(1)


class Common:
    """Hashes of common grams, looked up behind a bit map that lets few others through."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def last(self, h: np.ndarray) -> np.ndarray:
        """h with the top bit set where the gram is common, so that it comes last as an anchor."""
        if len(self.sorted):
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(maybe):
                k = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
                h[maybe[self.sorted[k] == h[maybe]]] |= _TOP
        return h


def anchors(texts: list[bytes], least: int, common: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first, last): runs of window starts of a text that have the same anchor, the leftmost on ties.

    Texts are hashed together in slabs; a long one is cut, its windows are not. A gram's high bits and its
    place are one number, so that the least of a window tells both.
    """
    found, slab, size = [], [], 0

    def flush():
        text = np.frombuffer(b"".join([t[a : a + n + least - 1] for t, _, a, n in slab]), np.uint8)
        h, width, step = common.last(grams(text)), least - K + 1, 1
        v = h & ~np.uint64(PLACES - 1) | np.arange(len(h), dtype=np.uint64)
        while 2 * step <= width:
            v, step = np.minimum(v[:-step], v[step:]), 2 * step
        if off := width - step:
            v = np.minimum(v[:-off], v[off:])
        n = np.array([x[3] for x in slab])
        ends = np.cumsum(n + least - 1)
        begin = ends - n - least + 1
        inside = np.zeros(len(v) + 2, bool)  # inside[k + 1]: window k lies in one text
        for b, e in zip((begin + 1).tolist(), (begin + n + 1).tolist(), strict=True):
            inside[b:e] = True
        change = np.ones(len(v) + 1, bool)  # a text's first window follows windows across the texts' border
        np.not_equal(v[1:], v[:-1], out=change[1:-1])
        change |= inside[1:] != inside[:-1]
        at = np.flatnonzero(change)
        first, last = at[:-1], at[1:] - 1
        ok = inside[first + 1]
        first, last = first[ok], last[ok]
        owner = np.searchsorted(begin, first, side="right") - 1
        shift = np.array([x[2] for x in slab]) - begin
        found.append((h[(v[first] & np.uint64(PLACES - 1)).astype(np.int64)], np.array([x[1] for x in slab])[owner], first + shift[owner], last + shift[owner]))

    for k, t in enumerate(texts):
        windows = len(t) - least + 1
        for a in range(0, windows, SLAB):
            n = min(SLAB, windows - a)
            slab.append((t, k, a, n))
            size += n + least
            if size >= SLAB:
                flush()
                slab, size = [], 0
    if slab:
        flush()
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more, by prefix doubling of those not yet told apart."""
    n = len(text)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(8, np.int64)])
    for j in range(7):  # symbols have 9 bits
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key)
    s = key[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    del key, s, padded
    slot = np.maximum.accumulate(np.where(same[:n], 0, np.arange(n)))
    rank = np.empty(n, np.int64)
    rank[order] = slot  # a suffix's rank is the first place of those that equal it
    at, size = np.flatnonzero(same[:n] | same[1:]), 7
    while size < depth and len(at):
        who = order[at]
        ahead = who + size
        later = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + later
        by = np.argsort(key)
        who, s = who[by], key[by]
        order[at] = who
        same = np.concatenate([[False], s[1:] == s[:-1], [False]])
        rank[who] = np.maximum.accumulate(np.where(same[:-1], 0, at))
        at = at[same[:-1] | same[1:]]
        size *= 2
    return order


def boundaries(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Booleans over order: whether a suffix shares fewer than `least` symbols with the one before.

    Breadth-first backward extension: the interval of c w is reached from that of w through the BWT; if
    the place after it has no common prefix yet, it is |w| there. Intervals whose end is known are
    not followed.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.uint16)
    by_char = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    del by_char
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        one = hi - lo == 1
        single = lf[lo[one]]
        lo, hi = lo[~one], hi[~one]
        size = hi - lo
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(lo - start, size)
        # Places by the BWT's symbol and place: one symbol's places of an interval follow each other.
        to = lf[at]
        by = np.argsort(to)
        to, owner = to[by], np.repeat(np.arange(len(lo)), size)[by]
        char = bwt[at[by]]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (char[1:] != char[:-1])])) if len(to) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(to)))
        lo = np.concatenate([to[new], single])
        hi = np.concatenate([to[new] + count, single + 1])
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        # Of intervals with one end, any will do: their ends are what the next level is reached from.
        place = np.argsort(hi)
        keep = np.concatenate([[True], hi[place][1:] != hi[place][:-1]])
        lo, hi = lo[place[keep]], hi[place[keep]]
        known[hi] = True
    return known[:n]


def repeated(regions: list[bytes], doc: np.ndarray, sub: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, offset) of the windows of distinct regions that also start earlier in another one."""
    lens = np.array([len(r) for r in regions])
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.cumsum(lens + 1) - lens - 1
    text[begin + lens] = 0  # parts the regions
    order = suffix_array(text, least)
    edge = boundaries(text, order, least)
    owner = np.repeat(np.arange(len(regions)), lens + 1)[order]
    offset = order - begin[owner]
    window = offset + least <= lens[owner]
    group = np.cumsum(edge)[window]
    owner, offset = owner[window], offset[window]
    if not len(group):
        return owner, offset
    # Windows in order of doc, sub and place: documents are numbered in that order.
    by = np.lexsort((sub, doc))
    fresh = np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (sub[by][1:] != sub[by][:-1])])
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(fresh)
    place = first[owner] + offset
    key = number[owner] * (int(place.max()) + 1) + place
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    later = key != np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(group))))
    return owner[later], offset[later]


def repeated_in_passes(regions: list[bytes], doc: np.ndarray, sub: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """repeated(), whose arrays hold at most about ARRAY bytes, for regions of any number.

    Windows that start with the same gram are compared in the same pass, as regions of their own.
    """
    total = sum(map(len, regions))
    if total <= 2 * ARRAY:
        return repeated(regions, doc, sub, first, least)
    starts = np.array([len(r) - least + 1 for r in regions])
    begin = np.cumsum([len(r) for r in regions]) - np.array([len(r) for r in regions])
    text = np.frombuffer(b"".join(regions), np.uint8)
    gram = np.concatenate([grams(text[b : b + n + K - 1]) for b, n in zip(begin.tolist(), starts.tolist(), strict=True)])
    passes = np.uint64(-(-int(starts.sum()) * least // ARRAY))
    owner, out = np.repeat(np.arange(len(regions)), starts), [(np.zeros(0, np.int64),) * 2]
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    which = gram % passes
    for k in range(int(passes)):
        mine = np.flatnonzero(which == np.uint64(k))
        if not len(mine):
            continue
        o, at = owner[mine], offset[mine]
        pieces = [regions[r][a : a + least] for r, a in zip(o.tolist(), at.tolist(), strict=True)]
        found, _ = repeated(pieces, doc[o], sub[o], first[o] + at, least)
        out.append((o[found], at[found]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.astype("<i8").tobytes() for a in arrays))


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(n, -1)


def _shards(df: DataFrame, column: str, fn, schema: str, parts: int) -> DataFrame:
    """fn(list of row tuples) for all rows of a shard; shards are dealt and sorted first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    prepare(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = df.columns.index(column)

    def run(batches):
        held, key = [], None

        def out():
            made = fn(held)
            held.clear()
            for s in range(0, len(made[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000], t.type) for c, t in zip(made, arrow, strict=True)], schema=arrow)
            give_back()

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[at] != key:
                    if held:
                        yield from out()
                    key = row[at]
                held.append(row)
        if held:
            yield from out()

    # By number: dealt by a hash of it, several shards would meet in one task.
    return df.repartitionById(parts, F.col(column).cast("int")).sortWithinPartitions(column).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text): `sub` tells apart the texts without a doc_id or under one doc_id, by their hash; else it is 0."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    ids = scratch(seen.filter(F.col("lo") != F.col("hi")).select(F.col("doc_id").alias("_key")), "ids")
    many, known, odd = ids.count(), docs.select("doc_id", "text"), F.col("doc_id").isNull() | (F.col("doc_id") == NO_ID)
    if many:
        ids = ids.withColumn("_again", F.lit(True))
        known = known.withColumn("_key", F.coalesce("doc_id", own)).join(F.broadcast(ids) if many <= REPEATED else ids, "_key", "left")  # no null keys: they would meet in one task
        odd |= F.col("_again").isNotNull()
    return known.select("doc_id", F.when(odd, own).otherwise(F.lit(0).cast("long")).alias("sub"), "text")


def common_grams(docs: DataFrame, least: int) -> np.ndarray:
    """Hashes of the most frequent anchors in a sixteenth of the documents: they only steer the dealing."""
    some = docs.filter(F.pmod(F.when(F.col("sub") == 0, F.xxhash64(F.lit("grams"), "doc_id")).otherwise(F.xxhash64(F.lit("grams"), "sub")), F.lit(16)) == 0)

    def make():
        none = Common(np.zeros(0, np.uint64))

        def f(doc, text):
            h, n = np.unique(anchors([(t or "").encode() for t in text], least, none)[0], return_counts=True)
            return [h.astype(np.int64).tolist(), n.tolist()]

        return f

    counted = map_columns(some.select("doc_id", "text"), make, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in rows], np.int64).astype(np.uint64)


class Regions:
    """Distinct pieces of text with their earliest places; `gone` holds the runs of window starts found equal to an earlier one."""

    def __init__(self, least: int):
        self.least, self.first, self.gone = least, {}, []

    def add(self, piece: bytes, d: int, u: int, first: int, h: int) -> None:
        have = self.first.setdefault(piece, (d, u, first, h))
        place = (d, u, first)
        if place < have[:3]:
            self.gone.append((*have[:3], have[2] + len(piece) - self.least))
            self.first[piece] = (*place, h)
        elif place > have[:3]:
            self.gone.append((*place, first + len(piece) - self.least))


def removed_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, sub, first, last): runs of window starts to remove from keyed docs, doc being doc_id or NO_ID.

    Null texts are empty and have none; equal rows have equal runs; an empty table gives none.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchor_shards, region_shards = max(8, -(-total // ANCHOR_SHARD)), max(16, -(-total // REGION_SHARD))
    often = common_grams(docs, least)

    def find():
        common = Common(often)

        def f(doc, sub, text):
            h, own, first, last = anchors([(t or "").encode() for t in text], least, common)
            owner, subs = np.array([NO_ID if d is None else d for d in doc], np.int64)[own], np.array(sub, np.int64)[own]
            # A common gram surely occurs twice: nothing is to be counted, so its anchors go to any shard.
            hot = h >= _TOP
            shard = (np.where(hot, (owner ^ subs).view(np.uint64) * _MUL >> np.uint64(20), h) % np.uint64(anchor_shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(anchor_shards + 1))
            pieces = [(s, by[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
            return [[s for s, _ in pieces], [_pack(h[k].view(np.int64), owner[k], subs[k], first[k] * least + last[k] - first[k]) for _, k in pieces]]

        return f

    def keep_repeated(rows):
        h, owner, sub, code = np.concatenate([_unpack(r[1], 4) for r in rows], axis=1)
        by = np.argsort(h)
        s = h[by]
        same = s[1:] == s[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (s < 0)
        k = by[twice]
        k = k[np.lexsort((code[k], sub[k], owner[k], h[k]))]
        fresh = np.ones(len(k), bool)  # equal rows are one document, whose anchors count once
        fresh[1:] = (h[k[1:]] != h[k[:-1]]) | (owner[k[1:]] != owner[k[:-1]]) | (sub[k[1:]] != sub[k[:-1]]) | (code[k[1:]] != code[k[:-1]])
        k = k[fresh]
        return [owner[k], sub[k], code[k], h[k]]

    found = map_columns(docs.select("doc_id", "sub", "text"), find, "shard long, blob binary")
    again = _shards(found, "shard", keep_repeated, "doc long, sub long, code long, h long", anchor_shards)
    # A document's anchors are bounded by its length.
    lists = again.groupBy("doc", "sub").agg(F.collect_list("code").alias("codes"), F.collect_list("h").alias("hs"))
    texts = squeezed(docs).filter(F.col("n_bytes") >= least).join(lists, ["doc", "sub"]).select("doc", "sub", "text", "codes", "hs")
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])

    def cut(batches):
        """Regions as rows of shards, equal ones merged: those of common grams through the whole task, the others in a batch."""
        widen, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        often_, held = Regions(least), 0

        def rows_of(*kinds):
            shards: dict[int, list] = {}
            gone = []
            for kind in kinds:
                for piece, (d, u, first, h) in kind.first.items():
                    shards.setdefault((h ^ h >> 17) % region_shards, []).append((h, d, u, first, piece))
                gone += kind.gone
                kind.gone = []
            out: list[list] = [[], [], [], []]
            for shard, rows in shards.items():
                rows.sort()
                head = _pack(*np.array([r[:4] for r in rows], np.int64).T, np.array([len(r[4]) for r in rows]))
                for column, x in zip(out, (shard, len(rows), head, squeeze.compress(b"".join([r[4] for r in rows]))), strict=True):
                    column.append(x)
            if gone:  # these only pass through, so any shard will do
                for column, x in zip(out, ((gone[0][0] ^ gone[0][1]) % region_shards, -1, _pack(*np.array(gone).T), None), strict=True):
                    column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for b in batches:
            here = Regions(least)
            for d, u, t, codes, hs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = widen.decompress(t)
                for c, h in zip(codes, hs, strict=True):
                    first, more = divmod(c, least)
                    (often_ if h < 0 else here).add(raw[first : first + more + least], d, u, first, h)
            often_.gone, here.gone = [], here.gone + often_.gone
            yield rows_of(here)
            if len(often_.first) > HELD:
                yield rows_of(often_)
                often_ = Regions(least)
        yield rows_of(often_)

    def expand(rows):
        widen = zstandard.ZstdDecompressor()
        out = [_unpack(r[2], 4) for r in rows if r[1] < 0]
        met = Regions(least)
        for _, n, head, body in rows:
            if n >= 0:
                raw, at = widen.decompress(body), 0
                for h, d, u, first, size in _unpack(head, 5).T.tolist():
                    met.add(raw[at : at + size], d, u, first, h)
                    at += size
        if met.gone:
            out.append(np.array(met.gone).T)
        if met.first:
            d, u, first, h = np.array(list(met.first.values())).T
            pieces = list(met.first)
            by = np.argsort(h, kind="stable")
            n = np.diff(np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1], [True]])))
            by = by[np.repeat(n, n) > 1]  # others met nothing but copies of themselves
            size = np.cumsum([len(pieces[k]) for k in by.tolist()])
            # Regions of one anchor stay together; arrays end with the anchor that reaches an eighth of ARRAY.
            ends = np.flatnonzero(np.concatenate([h[by][1:] != h[by][:-1], [True]])) + 1 if len(by) else []
            start, before = 0, 0
            for end in ends.tolist() if len(by) else []:
                if end < len(by) and size[end - 1] - before < ARRAY // 8:
                    continue
                part = by[start:end]
                start, before = end, size[end - 1]
                region, offset = repeated_in_passes([pieces[k] for k in part.tolist()], d[part], u[part], first[part], least)
                if len(region):
                    order = np.lexsort((offset, region))
                    region, offset = region[order], offset[order]
                    new = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (offset[1:] != offset[:-1] + 1)]))
                    last = np.append(new[1:], len(region)) - 1
                    at = part[region[new]]
                    out.append(np.stack([d[at], u[at], first[at] + offset[new], first[at] + offset[last]]))
        return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, np.int64)] * 4

    prepare(docs.sparkSession)
    shipped = texts.mapInArrow(cut, "shard long, n long, head binary, body binary")
    return _shards(shipped, "shard", expand, "doc long, sub long, first long, last long", region_shards)


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc, sub, doc_id, n_bytes, text binary) of keyed docs: texts as zstd, to move less; a null text is empty."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=1)

        def f(doc, sub, text):
            raw = [(t or "").encode() for t in text]
            return [[NO_ID if d is None else d for d in doc], sub, doc, [len(r) for r in raw], [squeeze.compress(r) for r in raw]]

        return f

    return map_columns(docs.select("doc_id", "sub", "text"), make, "doc long, sub long, doc_id long, n_bytes long, text binary")


def _joined(docs: DataFrame, least: int) -> DataFrame:
    docs = keyed(docs)
    runs = scratch(removed_runs(docs, least), "runs")
    lists = runs.groupBy("doc", "sub").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    return squeezed(docs).join(lists, ["doc", "sub"], "left").select("doc_id", "n_bytes", "text", "firsts", "lasts")


def _kept(text: bytes, n: int, firsts: list[int] | None, lasts: list[int] | None, least: int) -> tuple[bytes, int, int]:
    raw = zstandard.ZstdDecompressor().decompress(text)
    if not firsts:
        return raw, 0, 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(firsts, n), 1)
    np.add.at(edge, np.minimum(np.array(lasts) + least, n), -1)
    out = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(out & ~np.concatenate([[False], out[:-1]])))
    return np.frombuffer(raw, np.uint8)[~out].tobytes(), int(out.sum()), spans


def dedup_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    Null and empty texts, and texts shorter than `least` bytes, lose nothing. Equal rows are
    the same document and lose the same bytes; different texts without a doc_id, or under one, are
    documents of their own in order of their hash; a null doc_id comes after all others. Texts of any
    length are looked at whole, in slabs. An empty table gives none.
    """

    def make():
        def f(doc_id, n_bytes, text, firsts, lasts):
            got = [_kept(t, n, a, b, least) for t, n, a, b in zip(text, n_bytes, firsts, lasts, strict=True)]
            return [doc_id, n_bytes, [g[1] for g in got], [g[2] for g in got], [hashlib.sha256(g[0]).hexdigest() for g in got]]

        return f

    return map_columns(_joined(docs, least), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text): what is left of each text; bytes cut out of a character become U+FFFD.

    Null, empty, repeated and very long texts, and empty tables, fare as in dedup_digests().
    """

    def make():
        return lambda doc_id, n_bytes, text, firsts, lasts: [doc_id, [_kept(t, n, a, b, least)[0].decode(errors="replace") for t, n, a, b in zip(text, n_bytes, firsts, lasts, strict=True)]]

    return map_columns(_joined(docs, least), make, "doc_id long, text string")


#: DuckDB SQL for dedup_digests() over `documents`, whose doc_ids are unique and not null: all windows, by their MD5. Texts are hexadecimal, two digits a byte.
SQL = r"""
WITH hexed AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS s FROM hexed)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1),
edges AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens FROM later),
numbered AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edges),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, k),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM before JOIN hexed USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM hexed LEFT JOIN cut USING (doc_id)
"""
