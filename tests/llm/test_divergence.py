"""Source divergence against plain Python, with nulls, repeated rows, groups without terms and an empty table."""

import re
from collections import Counter, defaultdict

from captionloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        n[lang, source].update(words)
    kept = {lang: {t for t, k in c.items() if k >= min_docs} for lang, c in df.items()}
    groups = sorted({(lang, source) for lang, source, _ in docs})
    out = []
    for lang in {g[0] for g in groups}:
        terms, sources = kept.get(lang, set()), [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def shares(c, terms=terms):
            total = sum(c[t] for t in terms)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(terms)) for t in terms}

        q, p = shares(whole), {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in terms if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered[:most])]
    return sorted(out)


def check(spark, rows, min_docs, top):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, item string, `n.x` int")
    got = divergence.divergences(df, min_docs, top).collect()
    assert sorted(map(tuple, got)) == plainly(rows, min_docs, top)


def test_equals_plain_python(spark, rows):
    check(spark, [(lang, source, text) for _, text, lang, source, *_ in rows], 3, 7)


def test_ties_marks_nulls_and_groups_without_terms(spark):
    made = [("en", "a", "One two; TWO three-ÄÖ ǅ ünd\x00x\x7fy")] * 4 + [("en", "b", "two two two three")] * 3 + [("en", None, None), ("en", "c", "123 !?"), (None, "a", "one"), ("de", "z", ""), ("en", "é", "ÄÖ äö K İ")]
    check(spark, made, 3, 2)
    check(spark, made, 1, 50)


def test_no_kept_term_and_empty_table(spark):
    check(spark, [("en", "a", "x"), ("en", "b", "y")], 30, 50)
    check(spark, [], 30, 50)


def test_very_long_text(spark):
    check(spark, [("en", "a", "alpha beta " * 200_000), ("en", "b", "w" * 1_000_000 + " alpha")], 1, 50)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 4_000_000_000_000
    got = spark.createDataFrame([(n, 3 * n, 7)], "n long, t long, k long").select(divergence.share(F.col("n"), F.col("t"), F.col("k"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)
