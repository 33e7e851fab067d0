"""Language identification by cross-parsing.

A suffix automaton over labelled text of each language gives the longest match from any place of a
new text; walking it cuts the whole text, across words, into the fewest phrases that occur in the
language's text. Phrases are normalised to the cross-entropy that they estimate: a phrase points to a
place in the learned text, which takes the logarithm of its length in bits, so c phrases for n
characters are c log2(learned length) / n bits a character. The language with the fewest wins.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import map_columns

#: Bounds of the labelled sample: documents and characters learned for each language, and characters
#: for all languages together, which the languages share if they are many. They bound a worker's memory.
DOCS_PER_LANG = 150
CHARS_PER_LANG = 50_000
CHARS = 600_000
UNKNOWN = "und"

#: Characters that tell which language to parse with first; the answer does not depend on it.
GLANCE = 200

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is not held out, and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def plain(text: str) -> str:
    """Letters and their marks in small type, composed, with one space for whatever is between and at both ends."""
    return _OTHER.sub(" ", f" {unicodedata.normalize('NFC', text).lower()} ")


class SuffixAutomaton:
    """All substrings of a text as paths from the root; a state is a dict from characters to states."""

    def __init__(self, text: str):
        self.size = len(text)
        self.root: dict = {}
        nodes, link, size, last = [self.root], [-1], [0], 0
        number = {id(self.root): 0}
        for ch in text:
            node: dict = {}
            new, p = len(nodes), last
            nodes.append(node)
            number[id(node)] = new
            size.append(size[last] + 1)
            link.append(0)
            while p >= 0 and ch not in nodes[p]:
                nodes[p][ch] = node
                p = link[p]
            if p >= 0:
                to = nodes[p][ch]
                q = number[id(to)]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    twin, copy = len(nodes), dict(to)
                    nodes.append(copy)
                    number[id(copy)] = twin
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nodes[p].get(ch) is to:
                        nodes[p][ch] = copy
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def phrases(self, text: str, most: float = math.inf) -> tuple[int, int]:
        """How many longest matches cover the text, and 0; a character never seen is a phrase.

        With more than `most` phrases the parse ends: (most + 1, the characters that are left).
        """
        root, state, n, nothing = self.root, {}, 0, {}
        rest = iter(text)
        for ch in rest:
            state = state.get(ch)
            if state is None:  # a phrase begins
                n += 1
                if n > most:
                    return n, rest.__length_hint__() + 1
                state = root.get(ch, nothing)
        return n, 0


class CrossParser:
    """Automata of the languages' samples; `bits` is what a phrase of each language takes."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.automata = [SuffixAutomaton(samples[k]) for k in self.languages]
        self.bits = [math.log2(a.size + 2) for a in self.automata]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language of the least cross-entropy (ties: the first by name) and a score of 0 to 1.

        A language that needs more bits than the best has lost, wherever its parse stands: the score is
        the share of the text that then is left to the best of the losers, 1 without any. Texts are
        parsed with one language after the other, whose automaton so stays in the cache.
        """
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = {k: plain(t) for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)}
        count = len(self.languages)
        glance = [{k: a.phrases(t[:GLANCE])[0] * b for k, t in known.items()} for a, b in zip(self.automata, self.bits, strict=True)]
        likely = {k: min(range(count), key=lambda m: glance[m][k]) for k in known}
        least = {k: 0.0 for k in known}
        for m, a in enumerate(self.automata):
            for k in [k for k in known if likely[k] == m]:
                least[k] = a.phrases(known[k])[0] * self.bits[m]
        left: dict[int, list[int]] = {k: [0] * count for k in known}
        for m, (a, b) in enumerate(zip(self.automata, self.bits, strict=True)):
            for k in [k for k in known if likely[k] != m]:
                left[k][m] = a.phrases(known[k], math.floor(least[k] / b + 1e-9))[1]
        for k, t in known.items():
            best, stays = likely[k], left[k]
            if not all(x for m, x in enumerate(stays) if m != best):  # a rival came as far: all are compared anew
                bits = [a.phrases(t)[0] * b for a, b in zip(self.automata, self.bits, strict=True)]
                best = min(range(count), key=lambda m: (bits[m], m))
                stays = [a.phrases(t, math.floor(bits[best] / b + 1e-9))[1] for a, b in zip(self.automata, self.bits, strict=True)]
            out[k] = self.languages[best], min((x for m, x in enumerate(stays) if m != best), default=len(t)) / len(t)
        return out


_parsers: dict[str, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def learn(docs: DataFrame) -> dict[str, str]:
    """language -> text to learn from: texts in order of a hash, up to the bounds of the sample.

    About DOCS_PER_LANG documents of each language are drawn by the hash, cut to the characters that a
    language may have, and taken until it has them. Rows without lang or text, and held-out rows, are
    left out; no labelled rows give no languages.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    rates = {r["lang"]: min(1.0, DOCS_PER_LANG / r["n"]) for r in counts.collect()}  # a row for each language
    if not rates:
        return {}
    chars = min(CHARS_PER_LANG, CHARS // len(rates))
    table = F.broadcast(docs.sparkSession.createDataFrame(list(rates.items()), "lang string, rate double"))
    mixed = F.xxhash64(F.lit("lang-1"), "doc_id")
    drawn = usable.select("lang", "text", mixed.alias("mixed")).join(table, "lang").filter(F.pmod("mixed", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    drawn = drawn.select("lang", "mixed", F.xxhash64("text").alias("tie"), F.substring("text", 1, chars).alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("mixed", "tie").rowsBetween(Window.unboundedPreceding, -1))
    # At most twice `chars` of a language: the last text may go over.
    rows = drawn.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < chars).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["before"], r["text"])):
        texts.setdefault(r["lang"], []).append(plain(r["text"]))
    return {k: "\n".join(v) for k, v in texts.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone.

    `und` for null, empty and letterless texts, or if nothing was learned; repeated rows get equal
    answers; an empty table gives none.
    """

    def make():
        parser = _parser(samples)

        def f(doc, text):
            got = parser.predict(text)
            return [doc, [g[0] for g in got], [g[1] for g in got]]

        return f

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
