"""Signatures by hand, and the search over partitions against all pairs."""

import collections
import re

from pyspark.sql import functions as F

from captionloom.llm import spotsigs


def plain_signatures(text):
    """Chains as tuples of words: each anchor with the content words after it, and those at the start, counted."""
    words = re.findall(r"[^\W_]+", text.lower())
    content = [w for w in words if w not in spotsigs.ANCHORS]
    chains, passed = [], 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if passed < len(content):
                chains.append((w, *content[passed : passed + spotsigs.CHAIN]))
        else:
            passed += 1
    chains += [("", *content[: k + 1]) for k in range(spotsigs.CHAIN)]
    return collections.Counter(chains)


def test_signatures_stand_for_chains(rows):
    hasher, known = spotsigs.Hasher(), {}
    for _, text, *_ in rows:
        if text and text.strip() and len(plain_signatures(text)) > 2:
            bag = plain_signatures(text)
            assert len(spotsigs.signatures(text, hasher)) == len(set(spotsigs.signatures(text, hasher).tolist()))
            assert abs(len(spotsigs.signatures(text, hasher)) - sum(bag.values())) <= 1  # a start of one content word has one chain
            same = known.setdefault(frozenset(bag.items()), spotsigs.signatures(text, hasher).tolist())
            assert same == spotsigs.signatures(text, hasher).tolist()
    a, b = "the cat sat on the mat and the dog ran to a house", "the cat sat on the mat and the dog ran to a barn"
    x, y = plain_signatures(a), plain_signatures(b)
    exact = sum((x & y).values()) / sum((x | y).values())
    assert abs(spotsigs.likeness(spotsigs.signatures(a, hasher), spotsigs.signatures(b, hasher)) - exact) < 1e-9


def test_search_finds_all_like_texts(docs, empty):
    asks = F.col("doc_id") % 2 == 0
    for threshold in (0.5, 0.8):
        got = collections.Counter((r.doc_id, r.other_id, round(r.likeness, 9)) for r in spotsigs.like_fingerprints(docs, asks, threshold).collect())
        hasher = spotsigs.Hasher()
        made = [(r.doc_id, set(spotsigs.signatures(r.text, hasher).tolist())) for r in docs.filter("doc_id is not null").collect()]
        want = collections.Counter()
        for k, (i, x) in enumerate(made):
            for m, (j, y) in enumerate(made):
                near = len(x & y) / len(x | y) if x | y else 1.0
                if k != m and i % 2 == 0 and near >= threshold:
                    want[i, j, round(near, 9)] += 1
        assert got == want and want
    assert spotsigs.like_fingerprints(empty, asks).count() == 0


def test_small_likeness_is_exact():
    hasher = spotsigs.Hasher()
    a = spotsigs.signatures(" ".join(f"the word{k} and thing{k}" for k in range(400)), hasher)
    b = spotsigs.signatures(" ".join(f"the other{k} and stuff{k}" for k in range(390)) + " the word3 and thing3 the word4", hasher)
    exact = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert 0 < exact < 0.01
    assert spotsigs.likeness(a, b) == exact and spotsigs.likeness(a, b, 0.05) == 0.0
