"""Both ways of the edit distance against the plain table, and long near copies in bounded time."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from captionloom.functions import distance as d


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(r, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        k = r.randrange(len(out) + 1)
        what = r.randrange(3)
        if what == 0:
            out.insert(k, r.choice(letters))
        elif out and what == 1:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = r.choice(letters)
    return out


def test_both_ways_equal_the_table():
    r = random.Random(1)
    for case in range(1500):
        letters = list(range(r.choice([1, 2, 4, 300])))
        a = [r.choice(letters) for _ in range(r.randint(0, 40))]
        b = edited(r, a, r.randint(0, 12), letters) if case % 3 else [r.choice(letters) for _ in range(r.randint(0, 40))]
        want, x, y = plain(a, b), np.array(a, np.int64), np.array(b, np.int64)
        assert d.distance(x, y) == want
        assert d.by_columns(x, y) == want
        for most in (want, want + 5):
            assert d.by_diagonals(x, y, most) == want
        if want:
            assert d.by_diagonals(x, y, want - 1) is None


def test_runs_longer_than_a_stride():
    r = random.Random(2)
    a = [r.randrange(3) for _ in range(30_000)]
    b = edited(r, a, 9, [0, 1, 2])
    x, y = np.array(a), np.array(b)
    found = d.by_diagonals(x, y, 50)
    assert found == d.distance(x, y) <= 9
    assert d.by_columns(x[:3000], y[:3000]) == d.by_diagonals(x[:3000], y[:3000], 3000)


def test_megabytes_near_and_far():
    r = np.random.default_rng(3)
    a = r.integers(97, 123, 1_000_000)
    b = np.delete(a, r.choice(len(a), 150, replace=False))
    b[r.choice(len(b), 150, replace=False)] += 1
    began = time.process_time()
    assert 0 < d.distance(a, b) <= 300
    assert time.process_time() - began < 15
    c, e = r.integers(97, 123, 30_000), r.integers(97, 123, 30_000)
    began = time.process_time()
    assert 10_000 < d.distance(c, e) <= 30_000
    assert time.process_time() - began < 15


def test_columns(spark):
    rows = [("kitten", "sitting", ["a", "b", "c"], ["a", "c"]), ("", "日本語", [], ["x"]), ("same", "same", ["x"] * 5, ["x"] * 5), (None, "a", None, ["a"]), ("😀b", "b😀", ["a", "b"], ["b", "a"])]
    got = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>").select(d.text_distance(F.col("a"), F.col("b")).alias("t"), d.token_distance(F.col("x"), F.col("y")).alias("w")).collect()
    assert [tuple(g) for g in got] == [(3, 1), (3, 1), (0, 0), (None, None), (2, 2)]
    assert spark.createDataFrame([], "a string, b string").select(d.text_distance(F.col("a"), F.col("b"))).count() == 0


def test_near_copies_and_their_errors(spark):
    from captionloom.operators import metrics

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = " ".join(word() for _ in range(60))
    rows = [(5, base), (9, base + " more at the end"), (2, "Another start of it. " + base), (7, base), (1, "short"), (None, base), (3, None), (8, " ".join(word() for _ in range(60))), (11, base.upper())]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, side string")
    got = {(x.id, x.side): (x.other, x.distance, x.n_chars) for x in metrics.near_copy_errors(df).collect()}
    folded = lambda t: "".join(t.lower().replace(".", " ").split())
    want = {(9, "head"): 5, (7, "head"): 5, (5, "tail"): 2, (7, "tail"): 2}
    texts = dict(rows)
    assert got == {k: (o, plain(folded(texts[k[0]]), folded(texts[o])), len(folded(texts[o]))) for k, o in want.items()}
    assert metrics.near_copy_errors(df.limit(0)).count() == 0
