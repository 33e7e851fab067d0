"""The native scan against the same candidates, features and votes in plain Python."""

import hashlib
import re

import pytest

from captionloom.llm import secrets as s


def features(c, left, right, path):
    share = lambda p: len(re.sub(p, "", c)) / len(c)
    like = lambda x, p: float(bool(re.search(p, x)))
    low = c.lower()
    return {
        "size": min(len(c), 200.0), "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"), "runs": len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", c)) / len(c), "distinct": len(set(c)) / len(c),
        "pairs": len(re.findall("[aeiou][bcdfghjklmnpqrstvwxyz]", low)) / len(c), "plain": 1 - len(re.sub(s.PLAIN, "", low)) / len(c), "dictionary": 1 - len(re.sub(s.DICTIONARY, "", low)) / len(c), "hex": like(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"), "only_digits": like(c, "^[0-9.+/_-]+$"), "dots": share("[^.]"), "dashes": share("[^-/_]"),
        "prefixed": like(c, f"^(?:{s.ISSUED})"), "named": like(left, f"(?i)(?:{s.SECRET_NAMES})[\"' ]{{0,2}}[ :=>]{{0,4}}[\"']?\\Z"), "other": like(left, f"(?i)\\b(?:{s.OTHER_NAMES})[\"' ]{{0,2}}[ :=#>]{{0,4}}[\"']?\\Z"), "quoted": float(left[-1:] in "\"'`" and left != "" and right[:1] in "\"'`" and right != ""),
        "assigned": like(left, "[:=] ?[\"'`]?\\Z"), "mail": float(left.endswith("@") or right.startswith("@")), "iban": like(c, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{6,}"), "worded": float(bool(re.search(r"[.,;|] \Z", left)) or (len(left) > 1 and left[-1] == " " and left[-2].islower())), "test_path": like(path, f"(?i)(?:{s.TEST_PATH})"), "login": float(bool(re.search(r"://[^\s:/@]*:\Z", left)) and right.startswith("@")),
    }


def candidates(text):
    """(start, end) of each candidate: a match, or what follows its first group."""
    return [m.span(2 if m[2] else 4 if m[4] else 0) for m in re.finditer(s.CANDIDATE, text)]


def near(left):
    return left[-s.CONTEXT :] if not re.search(r"\s{3}", left[-s.CONTEXT :]) else re.sub(r"\s{2,}", " ", left)[-s.CONTEXT :]


def vote(tree, f):
    while not isinstance(tree, float):
        k, threshold, low, high = tree
        tree = low if f[s.FEATURES[k]] <= threshold else high
    return tree


def test_scan_equals_plain_python(spark):
    rows = [(k, left + c + right, path) for k, (left, c, right, path, _) in enumerate(s.labelled_findings(300, seed=5))]
    rows += [(1000, " ".join(r[1] for r in rows), "src"), (1001, None, None), (1002, "", "x"), (1003, "token=abc123abc123abc123 token=abc123abc123abc123", None)]
    trees = s.forest(spark)
    want = []
    for i, text, path in rows:
        spans = candidates(text or "")
        for k, (at, end) in enumerate(spans):
            c, left = text[at:end], near(text[spans[k - 1][1] if k else 0 : at])
            right = text[end : spans[k + 1][0] if k + 1 < len(spans) else len(text)]
            f = features(c, left, right[: s.CONTEXT], path or "")
            score = sum(vote(t, f) for t in trees) / len(trees)
            if score >= 0.5:
                want.append((i, at, len(c), hashlib.sha256(c.encode()).hexdigest(), pytest.approx(score, abs=1e-6)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.start, r.length, r.secret_sha256, r.score) for r in s.scan(df, trees).collect())
    assert len(got) == len(want) > 200
    assert got == sorted(want, key=lambda w: w[:3])
