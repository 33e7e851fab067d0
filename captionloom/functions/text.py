"""Text expressions: trimming, folding, tokens, edit distances, timestamps, numbers, terms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: What Python calls white space, as a Java class (Java's own classes differ from it).
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"
TOKEN = r"[\p{L}\p{N}]+"
NUMBER = r"(?U)(?<!\w)\d+(?:[.,]\d+)*(?!\w)"
#: Where a line ends; \r\n counts once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Code points for tokens start beyond the surrogates; there are over a million.
_FIRST_CODE = 0x10000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


@pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC, then full case folding: Spark has neither. ASCII needs only lower()."""
    return texts.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


def tokens(c: Column) -> Column:
    """Folded runs of letters and numbers."""
    return F.regexp_extract_all(nfkc_casefold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row: inside a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance over arrays of tokens: each distinct token becomes a code point for levenshtein()."""

    def encoded(x: Column, known: Column) -> Column:
        code = lambda t: F.lpad(F.hex(F.array_position(known, t) + F.lit(_FIRST_CODE)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(x, code), "")), "UTF-32")

    return let(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(encoded(a, known), encoded(b, known)))


def error_rate(distance: Column, expected: Column, candidate: Column) -> Column:
    """distance / expected; without expected units 0 if there is no candidate unit either, else 1."""
    return F.when(expected == 0, F.when(candidate == 0, 0.0).otherwise(1.0)).otherwise(distance / F.nullif(expected, F.lit(0)))


def has_run(sequence: Column, part: Column) -> Column:
    """Whether the tokens of `part` stand next to each other in `sequence`; an empty part is not found."""
    around = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(part) > 0) & F.contains(around(sequence), around(part))


def contains_term(text: Column, term: Column) -> Column:
    """Whether the term stands in the text as whole words, whatever its case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)")))


def numbers(text: Column, locale: str) -> Column:
    """The numbers of a text as canonical strings: `decimal_comma` drops points, `decimal_point` drops commas.

    A token that is no number after that is `malformed:` and the token.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    plain = (lambda t: F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))) if locale == "decimal_comma" else (lambda t: F.replace(t, F.lit(","), F.lit("")))
    short = lambda t: F.regexp_replace(F.regexp_replace(t, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return F.transform(found, lambda t: F.when(plain(t).rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(short(plain(t)), r"\.$", "")).otherwise(F.concat(F.lit("malformed:"), t)))


def finite(c: Column) -> Column:
    """Not NaN and not infinite; null stays null."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def parse_timestamp(c: Column) -> Column:
    """HH:MM:SS,mmm or HH:MM:SS.mmm as milliseconds; null for any other shape."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d+):(\d+)[,.](\d+)$", k)
    number = lambda k: F.expr("null") if k is None else part(k).try_cast("bigint")
    return F.when(c.rlike(r"^\d+:\d+:\d+[,.]\d+$"), ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + number(4))


def format_timestamp(ms: Column, mark: str) -> Column:
    """Milliseconds as HH:MM:SS and three decimals; below zero counts as zero; hours may have more digits."""
    m = F.greatest(ms, F.lit(0)).cast("bigint")
    whole = lambda n: F.expr("1") * F.floor(m / n)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, m % 1000)


def to_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000).cast("bigint")
