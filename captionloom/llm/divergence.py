"""Source divergence audit: how far each source's use of terms lies from the other sources' of its language.

Plain relational: terms are exploded once for each document's occurrences and once for each document,
counted by (lang, source, term), and joined with the terms that a language keeps. The kept vocabulary
is crossed with the language's groups on lang, so that a term a source never uses has a count of zero;
a self-join on (lang, term) compares sources, and windows rank.

Counts are summed within tasks before they are sent, so a frequent term or a hot source is a row a
task. Tables that are joined more than once are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import join_checked, scratch

#: A term: a run of letters A to Z and characters beyond ASCII. All other characters become spaces first:
#: an expression of the ranges themselves takes ten times as long.
TERM = "[^ ]+"
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def terms(text: Column) -> Column:
    """The terms of a text in order; only A to Z become small letters."""
    return F.regexp_extract_all(F.translate(text, _UPPER + _OTHER, _LOWER + " " * len(_OTHER)), F.lit(TERM), F.lit(0))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it); null text, lang and source are ''."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    words = rows.filter(F.col("text") != "").select("lang", "source", terms(F.col("text")).alias("words"))
    # Occurrences first, then each document's distinct terms: both in one pass over the text.
    both = words.select("lang", "source", F.posexplode(F.array("words", F.array_distinct("words"))).alias("kind", "list"))
    each = both.select("lang", "source", "kind", F.explode("list").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("kind").cast("long")).alias("n"), F.sum(F.col("kind").cast("long")).alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kinds)) in exact whole numbers."""
    above = (count.cast("decimal(19,0)") + F.lit(SMOOTH)) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(19,0)") + kinds.cast("decimal(19,0)") * F.lit(SMOOTH)
    return (F.call_function("div", above, below) + 1).cast("long")


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) all other sources and the `top` terms it overuses.

    Part `pair` has a row for each other source of the lang, its value the summed distances of the smoothed
    shares over all kept terms (0 where the lang keeps none); part `term` has terms whose share in the group
    is above the lang's. Values descend, ties by item in order of code points. Null text, lang and source
    are ''; groups without terms take part; texts of any length count as a whole; repeated rows are
    documents of their own; an empty table gives none; further columns are ignored.
    """
    counts = scratch(term_counts(docs), "term-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = scratch(of_lang.select("lang", "term", "lang_n"), "kept-terms")
    lang_sums = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kinds"))
    used = scratch(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "used-terms")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    # A row for each (lang, source).
    groups = scratch(groups.join(totals, ["lang", "source"], "left").join(lang_sums, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "groups")
    cells = join_checked(kept, groups, ["lang"]).join(used, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    dense = scratch(cells.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "dense-terms")

    mine, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    apart = mine.join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    half = apart.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    names = groups.select("lang", "source")
    others = join_checked(names, names.withColumnRenamed("source", "item"), ["lang"]).filter(F.col("source") != F.col("item"))
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    over = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    # Ranked apart, so that each task sends only its own `top` terms of a group.
    return pairs.select("*", rank).unionByName(over.select("*", rank).filter(F.col("rank") <= top))


#: DuckDB SQL for divergences() over `documents`; whole numbers of 128 bits.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
lang_sums AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS kinds FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, n FROM counts JOIN kept USING (lang, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals USING (lang, source)),
cells AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.total::HUGEINT + 5 * s.kinds) AS p,
  1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (s.lang_total::HUGEINT + 5 * s.kinds) AS q
  FROM groups g JOIN kept k USING (lang) JOIN lang_sums s USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over_used AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C")::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_used))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
