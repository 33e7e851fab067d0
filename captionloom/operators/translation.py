"""Translations: batches, decoding of results, and checks against the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom import schemas
from captionloom.functions.text import contains_term, finite, is_blank, numbers, strip


def batches(segments: DataFrame, size: int = 40) -> DataFrame:
    """segments with `batch`: consecutive runs of `size` segments of a job."""
    order = Window.partitionBy("job_id").orderBy("seq")
    return segments.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def prompts(batched: DataFrame) -> DataFrame:
    """(job_id, batch, payload): the JSON list of a batch's ids, texts and flags, in order."""
    item = F.struct("seq", "id", "text", "uncertainty")
    rows = batched.groupBy("job_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("job_id", "batch", F.to_json(F.transform("items", lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), s["uncertainty"].alias("uncertainty")))).alias("payload"))


def decode_results(results: DataFrame, source: DataFrame) -> DataFrame:
    """(job_id, payload) with {translations: [...]} against source segments -> schemas.TRANSLATIONS and `code`.

    Ids must be unique and the same on both sides and texts not empty, else all of the job's rows carry
    PROVIDER_FAILURE. Times, texts and flags come from the source, in the source's order.
    """
    items = results.select("job_id", F.explode(F.from_json("payload", schemas.TRANSLATED, {"mode": "FAILFAST"})["translations"]).alias("t")).select("job_id", "t.*")
    made = items.groupBy("job_id", "id").agg(F.count("*").alias("_n"), F.first("text").alias("_text"), F.first("uncertain").alias("_uncertain"), F.first("notes").alias("notes"))
    both = source.withColumn("_mine", F.lit(True)).join(made, ["job_id", "id"], "full_outer")
    bad = F.col("_mine").isNull() | F.col("_n").isNull() | (F.col("_n") > 1) | is_blank(F.coalesce("_text", F.lit("")))
    flagged = both.withColumn("_bad", F.max(bad).over(Window.partitionBy("job_id"))).filter("_mine")
    more = F.when(F.col("_uncertain"), F.array_union("uncertainty", F.array(F.lit("translation_uncertain")))).otherwise(F.col("uncertainty"))
    return flagged.select("job_id", "seq", "id", "start", "end", F.col("text").alias("source_text"), strip(F.col("_text")).alias("text"), more.alias("uncertainty"), F.coalesce("notes", F.lit("")).alias("notes"), F.when(F.col("_bad"), "PROVIDER_FAILURE").alias("code"))


def multiset_minus(a: Column, b: Column) -> Column:
    """The elements of a left after each of b took one equal: a difference of multisets, in order of value."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    left = lambda v: F.greatest(count(a, v) - count(b, v), F.lit(0))
    return F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda v: F.array_repeat(v, left(v))))


def id_differences(source: DataFrame, translated: DataFrame) -> DataFrame:
    """(job_id, missing, extra, duplicates): ids on one side only, and ids given twice."""
    ids = lambda d, n: d.groupBy("job_id", "id").agg(F.count("*").alias(n))
    both = ids(source, "a").join(ids(translated, "b"), ["job_id", "id"], "full_outer")
    return both.groupBy("job_id").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("duplicates"))


def validate_translation(source: DataFrame, translated: DataFrame, terms: list[str], source_locale: str = "decimal_comma", target_locale: str = "decimal_point") -> DataFrame:
    """(job_id, seq, rule) violations; seq is null for those of a whole job.

    Jobs with duplicate ids or other ids than the source's report only that. Numbers are compared as
    multisets of canonical values; a number that is none after its locale's rules is reported as such.
    """
    sides = id_differences(source, translated)
    whole = sides.select("job_id", F.lit(None).cast("int").alias("seq"), F.explode(F.array_compact(F.array(F.when(F.col("duplicates") > 0, F.lit("duplicate segment identifiers")), F.when((F.col("missing") > 0) | (F.col("extra") > 0), F.lit("translation coverage is incomplete"))))).alias("rule"))
    open_ = sides.filter("missing = 0 and extra = 0").select("job_id")
    t = translated.select("job_id", "id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("source_text").alias("_source"), F.col("text").alias("_text"), F.col("uncertainty").alias("_flags"))
    both = source.join(open_, "job_id", "left_semi").join(t, ["job_id", "id"])
    timed = finite(F.col("_s")) & finite(F.col("_e"))
    moved = timed & ((F.abs(F.col("_s") - F.col("start")) > 0.001) | (F.abs(F.col("_e") - F.col("end")) > 0.001))
    both = both.withColumn("_have", numbers(F.col("text"), source_locale)).withColumn("_got", numbers(F.col("_text"), target_locale))
    bad = lambda x: F.startswith(x, F.lit("malformed:"))
    named = lambda x, what: F.transform(x, lambda v: F.concat(F.lit(f"{what} number "), v))
    proper = lambda c: F.filter(c, lambda v: ~bad(v))
    rules = [
        F.array_compact(F.array(
            F.when(is_blank(F.col("_text")), F.lit("empty translation")), F.when(moved, F.lit("timing changed")), F.when(~timed, F.lit("non-finite timing")), F.when(~F.col("_source").eqNullSafe(F.col("text")), F.lit("source text changed")),
            F.when(F.size(F.array_except(F.coalesce("uncertainty", F.array().cast("array<string>")), F.coalesce("_flags", F.array().cast("array<string>")))) > 0, F.lit("source uncertainty was dropped")),
        )),
        named(multiset_minus(proper("_have"), proper("_got")), "missing"), named(multiset_minus(proper("_got"), proper("_have")), "unexpected"),
        F.transform(F.filter(F.concat("_have", "_got"), bad), lambda v: F.concat(F.lit("malformed number "), F.substring(v, 11, 1 << 20))),
    ]
    for term in terms:
        mine, theirs = contains_term(F.col("text"), F.lit(term)), contains_term(F.col("_text"), F.lit(term))
        rules.append(F.array_compact(F.array(F.when(mine & ~theirs, F.lit(f"missing glossary term {term}")), F.when(~mine & theirs, F.lit(f"unexpected glossary term {term}")))))
    return whole.union(both.select("job_id", "seq", F.explode(F.concat(*rules)).alias("rule")))


def coverage(source: DataFrame, translated: DataFrame) -> DataFrame:
    """(job_id, coverage): translated rows for each source row; 0 without translations."""
    n = source.groupBy("job_id").agg(F.count("*").alias("n"))
    m = translated.groupBy("job_id").agg(F.count("*").alias("m"))
    return n.join(m, "job_id", "left").select("job_id", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("coverage"))
