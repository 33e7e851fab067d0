"""Several texts under one doc_id, and columns with awkward names."""

import collections

import pytest

from captionloom.llm import ngram_join
from tests.llm.test_operators import bag, brute_join


def texts():
    a, b, c = (" ".join(f"{k}{n}x" for n in range(120)) for k in "abc")
    return [(1, a), (1, b), (2, a), (3, b), (3, c), (4, b + " more"), (5, a + " more"), (3, c), (6, "two words"), (6, ""), (None, a), (6, "")]


@pytest.mark.parametrize("step", [1, 5, 7])
def test_texts_under_one_doc_id_keep_their_links(spark, step):
    rows = texts()
    rows = [rows[k * step % len(rows)] for k in range(len(rows))]
    got = bag(ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links", "n_text_links")
    assert got == collections.Counter(brute_join(rows))
    assert {k[0]: k[2] for k in got if k[0] in (4, 5)} == {4: 2, 5: 2}


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = [(i, t, "v", 1, 2) for i, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, mark int, `n``x` int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r[0], (r[1] or "")[:2], r[1].endswith("more"), *r[2:]) for r in kept.collect())
    want = [(1, "a0"), (1, "b0"), (3, "c0"), (6, "tw"), (6, ""), (6, ""), (None, "a0")]
    assert got == collections.Counter((i, t, False, "v", 1, 2) for i, t in want)
