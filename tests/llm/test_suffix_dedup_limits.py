"""Slabs, passes and periodic texts: cutting the work up changes no result."""

import collections
import random

import numpy as np

from captionloom.llm import suffix_dedup
from tests.llm.test_operators import brute_dedup


def test_slabs_cut_no_window(monkeypatch):
    r = random.Random(6)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 99, 100, 101, 150, 700, 3000, 250)] + [b"xy" * 300, b"z" * 500]
    none = suffix_dedup.Common(np.zeros(0, np.uint64))
    whole = suffix_dedup.anchors(texts, 100, none)
    windows = collections.Counter()
    for k, first, last in zip(*(c.tolist() for c in whole[1:]), strict=True):
        windows.update((k, s) for s in range(first, last + 1))
    assert windows == collections.Counter((k, s) for k, t in enumerate(texts) for s in range(len(t) - 99))
    monkeypatch.setattr(suffix_dedup, "SLAB", 120)
    expand = lambda a: {(k, s): h for h, k, first, last in zip(*(c.tolist() for c in a), strict=True) for s in range(first, last + 1)}
    assert expand(suffix_dedup.anchors(texts, 100, none)) == expand(whole)


def test_passes_find_what_one_array_finds(monkeypatch):
    r = random.Random(7)
    base = bytes(r.choice(b"abcdefgh") for _ in range(400))
    regions = list({base[a : a + r.randint(100, 170)] for a in (r.randrange(230) for _ in range(60))} | {bytes(r.choice(b"ab") for _ in range(130)) for _ in range(20)})
    doc, sub, first = (np.array([r.randrange(n) for _ in regions]) for n in (9, 1, 1000))
    one = suffix_dedup.repeated(regions, doc, sub, first, 100)
    monkeypatch.setattr(suffix_dedup, "ARRAY", 2000)
    some = suffix_dedup.repeated_in_passes(regions, doc, sub, first, 100)
    pairs = lambda x: sorted(zip(*(c.tolist() for c in x), strict=True))
    assert pairs(one) == pairs(some) and pairs(one)


def test_periodic_and_nested_texts(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij é") for _ in range(260))
    texts = ["z" * 400, "ab" * 150, "abc" * 100 + passage, passage[40:220], passage * 2, "q" * 99, "q" * 100, "q" * 101, "日本" * 120, passage[:120] + "!" + passage[120:], "0123456789" * 30 + "x" + "0123456789" * 12]
    rows = [(k * 3 % 11, t) for k, t in enumerate(texts)]
    got = {r_.doc_id: tuple(r_)[1:] for r_ in suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_dedup(rows)
    assert got == {i: want[i, t] for i, t in rows}
