"""Toxicity features, one boosting step and the calibration against plain Python; long runs of signs take linear time."""

import math
import random
import re
import time
import unicodedata

import numpy as np
import pytest

from captionloom.llm import toxicity

LEXICON = {"idiot": 5.0, "scum": 3.0, "bad": 1.5, "dégoûtant": 4.0, "grubl*": 2.5, "grublen*": 3.5}


def letter(c):
    return c.isalnum() and not c.isdecimal() and not unicodedata.category(c).startswith("N")


def runs(text, good):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and good(text[end]):
            end += 1
        if end > at:
            out.append((at, end))
        at = max(end, at + 1)
    return out


def masked(text):
    """Words with signs or digits for letters: letters and signs in turn, not after a letter or digit; the end may be signs."""
    signs, inner, tail = "0123456789@$*!|", "0123456789@$*!|.-", "0123456789@$*|"
    alike = lambda at, chars: next((k for k in range(at, len(text)) if text[k] not in chars), len(text))
    word = lambda at: next((k for k in range(at, len(text)) if not letter(text[k])), len(text))

    def chain(at):
        """The end of (signs letters)* from the end of a word, and whether there was one."""
        more = False
        while (k := alike(at, inner)) > at and (e := word(k)) > k:
            at, more = e, True
        return at, more

    out, at = [], 0
    while at < len(text):
        c, before = text[at], text[at - 1] if at else " "
        end = None
        if c in signs and not (before.isalnum() or before in "@$*!|"):
            k = alike(at, signs)
            if (e := word(k)) > k:
                end = alike(chain(e)[0], tail)
        elif letter(c) and not letter(before):
            e, more = chain(word(at))
            k = alike(e, tail)
            end = k if more or k > e else None
        if end:
            out.append(text[at:end])
            at = end
        else:
            at += 1
    return out


def plainly(text):
    """The features in order of their names, each from its definition."""
    text = text or ""
    raw = [text[a:b] for a, b in runs(text, letter)]
    n = len(raw)
    if not n:
        return dict.fromkeys(toxicity.FEATURES, 0.0)
    words = [text.lower()[a:b] for a, b in runs(text.lower(), letter)]
    strong = [k for k, w in enumerate(words) if LEXICON.get(w, 0) >= 3]
    weak = [k for k, w in enumerate(words) if 0 < LEXICON.get(w, 0) < 3]
    stem = {k: max((v for s, v in LEXICON.items() if s[-1] == "*" and w.startswith(s[:-1])), default=0) for k, w in enumerate(words)}
    stems = [k for k in stem if stem[k]]
    persons = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    signs = masked(text.lower())
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
    found = 0
    for m in signs:
        plain = "".join(leet.get(c, c) for c in m)
        found += any(LEXICON.get(x, 0) >= 3 for x in (plain, "".join(filter(letter, plain)), "".join(filter(letter, m))))
    return {
        "stem_rate": 100 * len(stems) / n,
        "stem_log": math.log(1 + len(stems)),
        "stem_kinds": len({words[k] for k in stems}),
        "stem_weight": sum(stem.values()) / n,
        "log_words": math.log(1 + n),
        "strong_rate": 100 * len(strong) / n,
        "strong_log": math.log(1 + len(strong)),
        "strong_kinds": len({words[k] for k in strong}),
        "weak_rate": 100 * len(weak) / n,
        "weight_rate": sum(LEXICON.get(w, 0) for w in words) / n,
        "weight_max": max((LEXICON.get(w, 0) for w in words), default=0),
        "near_second": 100 * sum(any(abs(p - k) <= 4 for p in persons) for k in strong) / n,
        "second_rate": 100 * len(persons) / n if strong or weak else 0.0,
        "capitals": sum(w[0].isupper() for w in raw) / n,
        "shouting": sum(len(w) > 1 and w.isupper() for w in raw) / n,
        "exclaim": 100 * text.count("!") / len(text),
        "punctuation": 100 * sum(c in "!?.,;:" for c in text) / len(text),
        "masked_rate": 100 * len(signs) / n,
        "masked_hits": math.log(1 + found),
        "stretched": float(any(len(set(text[k : k + 4])) == 1 and (text[k].isalnum() or text[k] == "_") for k in range(len(text) - 3))),
    }


def test_features_equal_plain_python():
    r = random.Random(9)
    bits = ["idiot", "IDIOT", "1d10t", "i.d.i.o.t", "scum", "Bad", "bad", "you", "Deine", "grublen", "grublost", "Grub", "dégoûtant", " ", " ", " ", " ", "\n", "!", "!!", "?", ".", ",", "a$$", "@", "*", "|", "-", "7", "word", "soooo", "____", "É", "ß", "ǅ", "日本", "_x"]
    texts = [None, "", " ", "!!!", "you idiot", "word!!$tupid", "x!y", "!x", "a-b.c"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        got, want = dict(zip(toxicity.FEATURES, toxicity.features(t, LEXICON), strict=True)), plainly(t)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), (t, {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 1e-9})


@pytest.mark.parametrize("sign", list("*!$@|.-0_") + ["*!", "$a", "a.", ".a-"])
def test_a_megabyte_of_any_sign_takes_below_a_second(sign):
    for text in (f"hello {sign * (1_000_000 // len(sign))} world", f"hello{sign * (1_000_000 // len(sign))}", sign * (1_000_000 // len(sign))):
        began = time.process_time()
        toxicity._MASKED.findall(text)
        assert time.process_time() - began < 1


def test_one_boosting_step_finds_the_best_splits(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 3)), 1)
    y = ((x[:, 1] + 0.3 * r.normal(size=300)) > 0.2).astype(float)
    edges, ((feature, cut, leaves),), base = toxicity.boost(x, y)
    assert abs(base - math.log(y.mean() / (1 - y.mean()))) < 1e-9
    b, g, h = toxicity.bins(x, edges), y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    gain = lambda rows: sum(g[rows]) ** 2 / (sum(h[rows]) + 1)

    def best(rows):
        found = []
        for f in range(3):
            for c in range(len(edges[f]) + 1):
                low = b[rows, f] <= c
                if min(low.sum(), (~low).sum()) >= toxicity.LEAF:
                    found.append((gain(rows[low]) + gain(rows[~low]) - gain(rows), f, c))
        return max(found, key=lambda s: s[0])

    def walk(node, rows):
        if node >= 2**toxicity.DEPTH - 1:
            leaf = node - (2**toxicity.DEPTH - 1)
            assert abs(leaves[leaf] - toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1)) < 1e-9
            return
        low = b[rows, feature[node]] <= cut[node]
        if 0 < low.sum() < len(rows):
            assert abs(gain(rows[low]) + gain(rows[~low]) - gain(rows) - best(rows)[0]) < 1e-9
        walk(2 * node + 1, rows[low])
        walk(2 * node + 2, rows[~low])

    walk(0, np.arange(300))


def test_isotonic_points_are_pooled_means():
    r = np.random.default_rng(5)
    raw = np.sort(r.normal(size=60))
    y, w = (r.random(60) < 1 / (1 + np.exp(-2 * raw))).astype(float), r.integers(1, 4, 60).astype(float)
    xs, ys = toxicity.isotonic(raw, y, w)
    mean = lambda i, j: (y[i : j + 1] @ w[i : j + 1]) / w[i : j + 1].sum()
    pooled = np.array([max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)])
    assert np.all(np.diff(ys) >= 0)
    edges = np.flatnonzero(np.diff(pooled) > 1e-12)
    # Each block's value is its mean drawn in by half a row.
    for block in np.split(np.arange(60), edges + 1):
        value = (pooled[block[0]] * w[block].sum() + 0.5) / (w[block].sum() + 1)
        assert abs(np.interp(raw[block[0]], xs, ys) - max(value, ys[0])) < 0.2


def test_learned_stems_are_shorter_words(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeilmnorst") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = [r.choice(words) for _ in range(30)] + ([f"grubl{r.choice(words)}" for _ in range(3)] if toxic else [])
        r.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert any(w.endswith("*") and "grubl".startswith(w[:-1][:5]) for w in model.lexicon)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[k] == y for k, y in labels) >= 390
