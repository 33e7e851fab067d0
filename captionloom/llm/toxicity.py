"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of learned lexicons, nearness of lexicon words to the second person,
capitals, punctuation and obfuscation rates. The lexicon is a short list of insults and what the labelled
sample adds: words whose document counts differ between the labels beyond chance. Trees and calibration are fitted in numpy on
the sample's feature rows, the calibration on scores of rows that their trees have not seen; scoring is
one pass over the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import map_columns, release, scratch
from captionloom.llm.langid import held_out

#: Bound of the labelled sample, in documents, and of the lexicon, in words.
SAMPLE_DOCS = 6_000
LEXICON_WORDS = 300
THRESHOLD = 0.7
ROUNDS, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 32, 15

_WORD = re.compile(r"[^\W\d_]+")
#: A match begins only where a run of signs or of letters does, and no run is given back: a text is read once, whatever it holds.
_MASKED = re.compile(r"(?<![^\W_])(?<![@$*!|])[0-9@$*!|]++[^\W\d_]++(?:[0-9@$*!|.-]++[^\W\d_]++)*+[0-9@$*|]*+|(?<![^\W\d_])[^\W\d_]++(?:(?:[0-9@$*!|.-]++[^\W\d_]++)++[0-9@$*|]*+|[0-9@$*|]++)")
#: Signs that stand for letters in disguised words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Second-person words in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie ti tú tus usted ustedes vosotros".split())
NEAR = 4
#: Common insults in the same languages, and the log odds that they have until a sample tells.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers trash garbage scum pathetic worthless disgusting clown dumb ugly filthy coward liar fool jerk bastard bitch asshole crap shit damn fuck fucking hate vermin imbecile "
    "imbécile crétin stupide débile ordure connard connasse salaud salope merde abruti minable dégoûtant nul raclure "
    "idiotin dumm dummkopf trottel arschloch scheiße scheisse abschaum versager widerlich erbärmlich hässlich miststück schwachkopf "
    "idiota estúpido estúpida imbécil tonto basura escoria patético mierda cabrón asqueroso inútil payaso perdedor".split()
)
GIVEN = 4.0
#: Lengths of the beginnings of words that the lexicon may hold; they are written with a star at the end.
STEMS = (4, 5, 6, 7)
#: Words that a worker remembers the weights of.
REMEMBERED = 300_000

FEATURES = ("stem_rate", "stem_log", "stem_kinds", "stem_weight", "log_words", "strong_rate", "strong_log", "strong_kinds", "weak_rate", "weight_rate", "weight_max", "near_second", "second_rate", "capitals", "shouting", "exclaim", "punctuation", "masked_rate", "masked_hits", "stretched")


class Weights(dict):
    """word -> (its log odds or None, its stem's or 0) by a lexicon; bounded."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float | None, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.lexicon.get(word), max((self.lexicon.get(f"{word[:n]}*", 0.0) for n in STEMS if len(word) >= n), default=0.0)
        if len(word) <= 40:
            self[word] = found
        return found


def features(text: str | None, known: Weights | dict[str, float]) -> list[float]:
    """The FEATURES of a text by a lexicon; all zero for null and empty texts."""
    known = known if isinstance(known, Weights) else Weights(known)
    text, lexicon = text or "", known.lexicon
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    weighed = list(map(known.__getitem__, words))
    hits = [i for i, (w, _) in enumerate(weighed) if w is not None]
    weights = [weighed[i][0] for i in hits]
    stems = [i for i, (_, w) in enumerate(weighed) if w]
    strong = [words[i] for i, w in zip(hits, weights, strict=True) if w >= 3]
    masked = _MASKED.findall(text.lower())
    found = 0
    for m in masked:
        plain = m.translate(_LEET)
        found += any(lexicon.get(x, 0) >= 3 for x in (plain, re.sub(r"[\W\d_]+", "", plain), re.sub(r"[\W\d_]+", "", m)))
    second = near = 0
    if hits:
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        second = len(persons)
        at = np.searchsorted(persons, hits)
        for h, k, w in zip(hits, at, weights, strict=True):
            if w >= 3 and any(abs(persons[j] - h) <= NEAR for j in (k - 1, k) if 0 <= j < second):
                near += 1
    chars = len(text)
    upper = sum(w.isupper() and len(w) > 1 for w in raw)
    marks = sum(map(text.count, "!?.,;:"))
    return [
        100 * len(stems) / n, np.log1p(len(stems)), len({words[i] for i in stems}), sum(weighed[i][1] for i in stems) / n,
        np.log1p(n), 100 * len(strong) / n, np.log1p(len(strong)), len(set(strong)), 100 * (len(hits) - len(strong)) / n, sum(weights) / n, max(weights, default=0.0), 100 * near / n,
        100 * second / n, sum(w[0].isupper() for w in raw) / n, upper / n, 100 * text.count("!") / chars, 100 * marks / chars, 100 * len(masked) / n, np.log1p(found), float(bool(re.search(r"(\w)\1\1\1", text))),
    ]


@dataclass
class Model:
    """lexicon word -> log odds; bin edges; trees as (feature, bin, leaves); calibration points."""

    lexicon: dict[str, float]
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    points: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = bins(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaves[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a small share of the raw one keeps the order within equal steps."""
        if not len(x):
            return np.zeros(0)
        raw = self.raw(x)
        p = 1 / (1 + np.exp(-raw))
        return np.clip(0.99 * np.interp(raw, *self.points) + 0.01 * p, 0.0, 1.0)


def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list, float]:
    """Trees for log odds of y: exact Newton steps over binned features, full binary trees of DEPTH."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = bins(x, edges)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    out, trees = np.full(len(y), base), []
    inner = 2**DEPTH - 1
    width = max(len(e) for e in edges) + 2
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width)  # unsplit: everything goes left
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = (1e-6, 0, width)
            if len(at) >= 2 * LEAF:
                g_all, h_all = g[at].sum(), h[at].sum()
                for f in range(b.shape[1]):
                    code = b[at, f]
                    gs, hs, ns = (np.cumsum(np.bincount(code, w, width))[:-1] for w in (g[at], h[at], None))
                    gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                    gain[(ns < LEAF) | (len(at) - ns < LEAF)] = -1
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (gain[j], f, j)
            feature[k], cut[k] = best[1:]
            node[at] = 2 * k + 1 + (b[at, feature[k]] > cut[k])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves = RATE * gs / (hs + 1)
        out += leaves[leaf]
        trees.append((feature, cut, leaves))
    return edges, trees, base


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising step function of weighted means, each drawn in by half a row."""
    blocks: list[list[float]] = []  # sum, weight, first, last
    for r, v, w in sorted(zip(raw.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([v * w, w, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs, ys = [], []
    for s, n, first, last in blocks:
        v = (s + 0.5) / (n + 1)
        xs += [first, last + 1e-9]
        ys += [v, v]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled, not held-out documents, at most about SAMPLE_DOCS of them drawn by a hash.

    A label has half of the sample, or what the other leaves, so that a rare one is still learned;
    rows are weighed by what they stand for when scores are calibrated. Lexicon and trees come from
    seven tenths of the sample and the calibration from the rest, which neither has seen. Labels of one
    document that differ count as the larger; null labels are none; equal texts count once. Without
    both labels the model is a constant.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    quota = {y: max(SAMPLE_DOCS // 2, SAMPLE_DOCS - count.get(1 - y, 0)) for y in (0, 1)}
    rate = {y: min(1.0, quota[y] / max(1, count.get(y, 0))) for y in (0, 1)}
    mixed = F.pmod(F.xxhash64(F.lit("tox-1"), "doc_id"), F.lit(1 << 30))
    drawn = usable.filter(mixed < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]) * (1 << 30))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    fits = F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(10)) < 7
    sample = scratch(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("fits", fits), "toxic-sample")
    size = {(r["fits"], r["toxic"]): r["count"] for r in sample.groupBy("fits", "toxic").count().collect()}
    pos, neg = (size.get((True, y), 0) for y in (1, 0))
    pos_all, neg_all = pos + size.get((False, 1), 0), neg + size.get((False, 0), 0)
    if not pos_all or not neg_all:
        release(sample)
        return Model({}, [np.zeros(0)] * len(FEATURES), [], 0.0, (np.array([0.0]), np.array([float(pos_all > 0)])))
    lexicon = _lexicon(sample.filter("fits"), pos, neg)

    def make():
        known = Weights(lexicon)
        return lambda text, toxic, fits: [toxic, fits, [[float(v) for v in features(t, known)] for t in text]]

    rows = map_columns(sample.select("text", "toxic", "fits"), make, "toxic int, fits boolean, x array<double>").collect()  # numbers of the bounded sample
    release(sample)
    rows.sort(key=lambda r: (r["x"], r["toxic"], r["fits"]))
    x, y, fit = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["fits"] for r in rows])
    if not pos or not neg or fit.all():  # a handful of rows: nothing can be set aside
        fit, rest = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        rest = ~fit
    model = Model(lexicon, *boost(x[fit], y[fit]), (np.array([0.0]), np.array([0.0])))
    model.points = isotonic(model.raw(x[rest]), y[rest], np.where(y[rest] == 1, 1 / rate[1], 1 / rate[0]))
    return model


def _lexicon(sample: DataFrame, pos: int, neg: int) -> dict[str, float]:
    """Words with log odds of the label: INSULTS, and those of the sample whose document counts differ beyond chance.

    Beginnings of words are counted as well: an inflected or compounded insult is rare in each of its
    forms. A stem is kept if more than one word has it, and only the shortest of those found alike.
    """

    def words():
        def f(text, toxic):
            out: tuple[list, list] = ([], [])
            for t, y in zip(text, toxic, strict=True):
                found = {w for w in _WORD.findall(t.lower()) if len(w) <= 40}
                found |= {f"{w[:n]}*" for w in found for n in STEMS if len(w) >= n}
                out[0].extend(found)
                out[1].extend([y] * len(found))
            return out

        return f

    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (pos + 1 - a)) - F.log(b / (neg + 1 - b))
    counted = map_columns(sample.select("text", "toxic"), words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    tested = counted.filter(F.col("a") >= 4).select("word", "a", "n", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).filter(F.col("z") > 3)
    stem = F.col("word").endswith("*")
    learned = {r["word"]: r for kind in (~stem, stem) for r in tested.filter(kind).orderBy(F.desc("z"), F.length("word"), "word").limit(LEXICON_WORDS).collect()}
    alike = lambda w, r: w.endswith("*") and any((x := learned.get(f"{w[:n]}*")) is not None and (x["a"], x["n"]) == (r["a"], r["n"]) for n in STEMS if n < len(w) - 1)
    return dict.fromkeys(INSULTS, GIVEN) | {w: float(r["odds"]) for w, r in learned.items() if not alike(w, r)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) from the text alone.

    Null and empty texts have zero features and the score that gives; repeated rows score alike; an
    empty table gives none.
    """

    def make():
        known = Weights(model.lexicon)

        def f(doc, text):
            s = model.score(np.array([features(t, known) for t in text]))
            return [doc, s.tolist(), (s >= THRESHOLD).astype(int).tolist()]

        return f

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")
