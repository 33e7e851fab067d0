"""Null and repeated doc_ids: each text loses its own repeats, not another's byte offsets."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from captionloom.llm import suffix_dedup

NO_ID = 2**63


def brute(rows, least=100):
    """rows of (doc_id, hash of the text, text); the hash parts the texts of one id."""
    texts = sorted({(NO_ID if i is None else i, h, t or "") for i, h, t in rows})
    first = {}
    for i, h, t in texts:
        b = t.encode()
        for s in range(len(b) - least + 1):
            first.setdefault(b[s : s + least], (i, h, s))
    out = {}
    for i, h, t in texts:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < (i, h, s):
                gone[s : s + least] = b"\1" * least
        out[i, h] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_null_and_repeated_ids(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "REPEATED", limit)
    made = [(r.doc_id, r.text) for r in docs.filter("length(text) < 5000 or text is null").select("doc_id", "text").collect()]
    passage, own = made[[i for i, _ in made].index(3)][1], [" ".join(f"{k}w{n * n}" for n in range(80)) for k in range(8)]
    made += [(None, own[0] + passage + own[1]), (None, own[2] * 2), (None, own[3]), (None, own[3]), (3, own[4] + own[5]), (3, own[6]), (7, own[4][50:] + own[7]), (None, own[7])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    rows = [tuple(r) for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()]
    want = brute(rows)
    got = collections.Counter(tuple(r) for r in suffix_dedup.dedup_digests(df).collect())
    assert got == collections.Counter((i, *want[NO_ID if i is None else i, h]) for i, h, _ in rows)
