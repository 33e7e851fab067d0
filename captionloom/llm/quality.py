"""Quality rules by repetition coverage.

Words are hashed once; hashes of n words are built by doubling (n = 4, 8, 16) in numpy, and every
n-gram found twice marks all its words. The measures are shares of the text's word characters that
lie inside duplicated n-grams or duplicated lines.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import WORD, add_columns, named

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
NGRAMS = (4, 8, 16)

#: Largest allowed share of word characters inside repeated n-grams or lines, and of symbols to words.
LIMITS = {"gram4": 0.50, "gram8": 0.35, "gram16": 0.25, "lines": 0.45, "symbols": 0.25}
MIN_WORDS = 20

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, gram4_chars long, gram8_chars long, gram16_chars long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(hashes: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which of the words lie in an n-gram whose hash occurs at least twice."""
    order = np.argsort(hashes)
    s = hashes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return np.zeros(n_words, bool)
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n_words + 1, np.int32)
    starts = order[twice]
    edge[starts] += 1  # starts differ from each other, so plain indexing adds each once
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The measures of SCHEMA for a text; a null text is an empty one."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    n_symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return 0, 0, n_symbols, 0, 0, 0, 0, 0, 0
    seen: set[str] = set()
    n_dup = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup += 1
            dup_chars += sum(map(len, _WORD.findall(line)))
        elif _WORD.search(line):
            seen.add(line)
    ids: dict[str, int] = {}
    h = _mix(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n))
    lens = np.fromiter(map(len, words), np.int64, n)
    base, size, found = np.uint64(0xD6E8FEB86659FD93), 1, {}
    while size < NGRAMS[-1] and len(h) > size:
        h = h[:-size] * base + h[size:]
        with np.errstate(over="ignore"):
            base, size = base * base, 2 * size
        if size in NGRAMS:
            found[size] = covered(h, size, n)
            if not found[size].any():  # then no longer n-gram repeats either
                break
    none = np.zeros(n, bool)
    chars = [int(lens[found.get(k, none)].sum()) for k in NGRAMS]
    return n, int(lens.sum()), n_symbols, n_dup, int(found.get(8, none).sum()), dup_chars, *chars


def score_quality(docs: DataFrame) -> DataFrame:
    """The columns of docs plus SCHEMA's measures and the booleans base_failed and kept.

    A null, empty or blank text has no words: all measures but n_symbols are 0 and it fails. Rows are
    judged one by one: repeated rows and ties get equal verdicts, an empty table stays empty. Columns
    of docs named like a measure, in any case of letters, give way to it; others ride along as they are.
    """

    def make():
        return lambda text: list(zip(*map(measure, text), strict=True))

    keep = [c for c in docs.columns if c.lower() not in ("base_failed", "kept")]
    got = add_columns(docs.select(*map(named, keep)), make, SCHEMA, "text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fails = F.lit(False)
    for k in NGRAMS:
        fails |= F.col(f"gram{k}_chars") > LIMITS[f"gram{k}"] * F.col("word_chars")
    fails |= F.col("dup_line_chars") > LIMITS["lines"] * F.col("word_chars")
    fails |= F.col("n_symbols") > LIMITS["symbols"] * F.col("n_words")
    return got.withColumn("base_failed", base).withColumn("kept", ~(base | fails))


#: DuckDB SQL for the query over `documents`, whose doc_ids are unique: words numbered, n-grams counted as strings.
SQL = r"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded) CROSS JOIN (SELECT unnest([4, 8, 16]) AS k) WHERE i + k - 1 <= len(w)),
twice AS (SELECT doc_id, k, unnest(list(i)) AS i FROM grams GROUP BY doc_id, k, g HAVING count(*) > 1),
inside AS (SELECT DISTINCT doc_id, k, i + unnest(range(0, k)) AS i FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE k = 8) AS n8, coalesce(sum(length(word)) FILTER (WHERE k = 4), 0) AS c4, coalesce(sum(length(word)) FILTER (WHERE k = 8), 0) AS c8, coalesce(sum(length(word)) FILTER (WHERE k = 16), 0) AS c16
  FROM inside JOIN words USING (doc_id, i) GROUP BY doc_id),
lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded)),
same AS (SELECT doc_id, count(*) - 1 AS again, (count(*) - 1) * any_value(chars) AS chars FROM lines WHERE n > 0 GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(again) AS n_dup, sum(chars) AS c_dup FROM same GROUP BY doc_id),
measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n8, 0)::BIGINT AS n_repeat_words, coalesce(c_dup, 0) AS c_dup, coalesce(c4, 0) AS c4, coalesce(c8, 0) AS c8, coalesce(c16, 0) AS c16
  FROM worded LEFT JOIN repeats USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * c4 > word_chars OR 20 * c8 > 7 * word_chars OR 4 * c16 > word_chars OR 20 * c_dup > 9 * word_chars OR 4 * n_symbols > n_words) AS kept FROM judged
"""
