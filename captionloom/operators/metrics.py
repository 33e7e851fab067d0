"""Transcript metrics, quality gates and the choice of a winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions.distance import text_distance, token_distance
from captionloom.functions.text import error_rate, has_run, is_blank, strip, tokens
from captionloom.operators.intervals import timing_iou

#: Gates of the example configuration.
GATES = {"max_wer": 0.20, "max_cer": 0.14, "min_number_recall": 1.0, "min_glossary_term_recall": 1.0, "min_timing_iou": 0.50}
#: Weights of the tie-breaking score.
SCORE = {"cer": 0.35, "glossary_term_recall": 0.15, "number_recall": 0.15, "punctuation_f1": 0.05, "timing_iou": 0.10}


def transcript_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the stripped texts that are not blank, in order of seq, joined by a space."""
    said = F.collect_list(F.when(~is_blank(F.col("text")), F.struct("seq", strip(F.col("text")).alias("text"))))
    rows = segments.groupBy(*keys).agg(F.array_sort(said).alias("_said"))
    return rows.select(*keys, F.array_join(F.transform("_said", lambda s: s["text"]), " ").alias("text"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal few but costly rows to all cores: adaptive execution would put what is few bytes into one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def word_error_rate(expected: Column, candidate: Column) -> Column:
    """Over arrays of tokens."""
    return error_rate(token_distance(expected, candidate), F.size(expected), F.size(candidate))


def char_error_rate(expected: Column, candidate: Column) -> Column:
    a, b = F.array_join(expected, ""), F.array_join(candidate, "")
    return error_rate(text_distance(a, b), F.length(a), F.length(b))


def near_copies(rows: DataFrame, id_: str = "doc_id", text: str = "text", shared: int = 100) -> DataFrame:
    """(side, id, other): each text with the first, by id, of those that begin (`head`) or end (`tail`) with as many equal characters.

    Texts of fewer characters, null texts and null ids have no pair, and the first of a group none either. A
    group's size does not matter: its first is found by an aggregate, and its rows are joined to it.
    """
    long_ = rows.filter((F.length(text) >= shared) & F.col(id_).isNotNull())
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.md5(c).alias("key"))
    keyed = long_.select(F.col(id_).alias("id"), F.explode(F.array(end("head", F.left(F.col(text), F.lit(shared))), end("tail", F.right(F.col(text), F.lit(shared))))).alias("e")).select("id", "e.*")
    first = keyed.groupBy("side", "key").agg(F.min("id").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(first, ["side", "key"]).filter("id != other").select("side", "id", "other")


def near_copy_errors(rows: DataFrame, id_: str = "doc_id", text: str = "text", shared: int = 100) -> DataFrame:
    """(id, side, other, n_chars, distance, cer): how far each near copy is from the first of its kind, over whole texts.

    Texts are folded as for the character error rate, of which the other's is the expected one; see
    near_copies() for which rows are compared.
    """
    # A pair that is alike at both ends is measured once.
    pairs = near_copies(rows, id_, text, shared).groupBy("id", "other").agg(F.sort_array(F.collect_set("side")).alias("sides"))
    of = lambda name, key: rows.filter(F.col(id_).isNotNull()).select(F.col(id_).alias(key), F.col(text).alias(name))
    both = pairs.join(of("_mine", "id"), "id").join(of("_other", "other"), "other")
    folded = both.select("id", "sides", "other", F.array_join(tokens(F.col("_other")), "").alias("_a"), F.array_join(tokens(F.col("_mine")), "").alias("_b"))
    measured = spread(folded, "id", "other").withColumn("distance", text_distance(F.col("_a"), F.col("_b")))
    return measured.select("id", F.explode("sides").alias("side"), "other", F.length("_a").alias("n_chars"), "distance", error_rate(F.col("distance"), F.length("_a"), F.length("_b")).alias("cer"))


def term_recall(terms: Column, candidate: Column) -> Column:
    """Share of terms (an array of arrays of tokens) found in the candidate's tokens; 1 without terms."""
    found = F.size(F.filter(terms, lambda t: has_run(candidate, t)))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) < 1, 1.0).otherwise(found / F.nullif(F.size(terms), F.lit(0)))


def punctuation_f1(expected: DataFrame, candidate: DataFrame, job: str = "job_id", track: str = "candidate") -> DataFrame:
    """(job, track, punctuation_f1) of texts: multiset F1 of punctuation characters."""
    marks = lambda d, keys: d.select(*keys, F.explode_outer(F.regexp_extract_all(F.col("text"), F.lit(r"\p{P}"), F.lit(0))).alias("mark")).groupBy(*keys, "mark").agg(F.count("mark").alias("n"))
    ours, theirs = marks(expected, [job]), marks(candidate, [job, track])
    tracks = candidate.select(job, track).distinct()
    both = theirs.withColumnRenamed("n", "m").join(tracks.join(ours, job), [job, track, "mark"], "full_outer")
    sums = both.groupBy(job, track).agg(F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))).alias("hit"), F.sum(F.coalesce("n", F.lit(0))).alias("a"), F.sum(F.coalesce("m", F.lit(0))).alias("b"))
    f1 = F.when(F.col("a") == 0, F.when(F.col("b") == 0, 1.0).otherwise(0.0)).when((F.col("b") == 0) | (F.col("hit") == 0), 0.0).otherwise(2 * F.col("hit") / F.nullif(F.col("a") + F.col("b"), F.lit(0)))
    return sums.select(job, track, f1.cast("double").alias("punctuation_f1"))


def evaluate(reference: DataFrame, candidates: DataFrame, terms: DataFrame, expected_numbers: DataFrame) -> DataFrame:
    """Six metrics for each (job_id, candidate).

    `reference` has segments (job_id, seq, start_ms, end_ms, text), `candidates` the same with
    `candidate`; `terms` and `expected_numbers` have (job_id, term) and (job_id, number), both matched
    as runs of tokens. Everything is keyed by job_id, so one exchange on it serves the joins.
    """
    ours, theirs = transcript_text(reference, ["job_id"]), transcript_text(candidates, ["job_id", "candidate"])
    listed = lambda d, c, name: d.select("job_id", tokens(F.col(c)).alias("t")).groupBy("job_id").agg(F.collect_list("t").alias(name))
    a = ours.select("job_id", tokens(F.col("text")).alias("expected"))
    b = theirs.select("job_id", "candidate", tokens(F.col("text")).alias("got"))
    both = b.join(a, "job_id").join(listed(terms, "term", "terms"), "job_id", "left").join(listed(expected_numbers, "number", "numbers"), "job_id", "left")
    both = spread(both, "job_id", "candidate")
    scored = both.select(
        "job_id", "candidate", word_error_rate(F.col("expected"), F.col("got")).alias("wer"), char_error_rate(F.col("expected"), F.col("got")).alias("cer"),
        term_recall(F.col("terms"), F.col("got")).alias("glossary_term_recall"), term_recall(F.col("numbers"), F.col("got")).alias("number_recall"),
    )
    return scored.join(punctuation_f1(ours, theirs), ["job_id", "candidate"]).join(timing_iou(reference, candidates), ["job_id", "candidate"])


def failed_gates(gates: dict[str, float] = GATES) -> Column:
    """The names of the gates that an evaluation misses; a value exactly at a gate passes."""
    rules = [("wer", F.col("wer") > gates["max_wer"]), ("cer", F.col("cer") > gates["max_cer"])]
    rules += [(m, F.col(m) < gates[f"min_{m}"]) for m in ("number_recall", "glossary_term_recall", "timing_iou")]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def score(weights: dict[str, float] = SCORE) -> Column:
    """Lower is better: wer, a share of cer and what the others lack to 1."""
    rest = [F.lit(weights[m]) * (1 - F.col(m)) for m in ("glossary_term_recall", "number_recall", "punctuation_f1", "timing_iou")]
    return sum(rest, F.col("wer") + F.lit(weights["cer"]) * F.col("cer"))


def gated(evaluations: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """Evaluations with failed_gates, score and status `eligible` or `rejected`."""
    out = evaluations.withColumn("failed_gates", failed_gates(gates)).withColumn("score", score())
    return out.withColumn("status", F.when(F.size("failed_gates") == 0, "eligible").otherwise("rejected"))


def select_winner(evaluations: DataFrame, native: str = "native", least: int = 2) -> DataFrame:
    """(job_id, selected, code): the eligible candidate of least wer; ties go to `native`, then score, then name.

    code is null, ASR_CANDIDATES_INSUFFICIENT below `least` evaluations or ASR_QUALITY_GATES_FAILED.
    """
    judged = gated(evaluations) if "status" not in evaluations.columns else evaluations
    key = F.struct("wer", (F.col("candidate") != native).alias("other"), "score", "candidate")
    out = judged.groupBy("job_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("status") == "eligible", key)).alias("best"))
    code = F.when(F.col("n") < least, "ASR_CANDIDATES_INSUFFICIENT").when(F.col("best").isNull(), "ASR_QUALITY_GATES_FAILED")
    return out.select("job_id", F.when(code.isNull(), F.col("best.candidate")).alias("selected"), code.alias("code"))


def selected_candidates(winners: DataFrame, single: str | None = None) -> DataFrame:
    """In single mode the configured candidate, whatever an earlier evaluation chose; else the winner."""
    return winners.withColumn("selected", F.coalesce(F.lit(single), F.col("selected")))


def native_is_eligible(evidence: DataFrame, language: str = "pt-BR") -> DataFrame:
    """Rows of caption evidence that may stand as a candidate."""
    return evidence.filter((F.col("origin") == "player_track") & (F.col("language") == language) & (F.col("coverage") >= 0.95) & F.col("manually_spot_checked").eqNullSafe(F.lit(True)))


def ranked(evaluations: DataFrame) -> DataFrame:
    """All candidates of a job in the order of choice, rejected ones last."""
    order = Window.partitionBy("job_id").orderBy(F.col("status") != "eligible", "wer", F.col("candidate") != "native", "score", "candidate")
    return gated(evaluations).withColumn("place", F.row_number().over(order))
