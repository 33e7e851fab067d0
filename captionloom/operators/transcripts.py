"""Transcripts: decoding, two shapes of recogniser responses, offsets, merging, planning, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom import schemas
from captionloom.functions.text import finite, is_blank, strip

DEFAULTS = {"provider": "manual", "model": "reference", "source": "manual_reference"}


def decode_transcripts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """job_id and JSON text -> header columns, glossary_terms, numbers, segments, and `code`.

    A payload that is no JSON object or lacks segments gets ARTIFACT_INVALID and nulls. Unknown keys are
    ignored; null texts are refused like missing ones.
    """
    p = F.from_json(column, schemas.TRANSCRIPT, {"mode": "PERMISSIVE"})
    read = payloads.withColumn("_p", p)
    bad = F.col("_p").isNull() | F.col("_p.segments").isNull() | F.exists("_p.segments", lambda s: s["text"].isNull() | s["id"].isNull() | s["start"].isNull() | s["end"].isNull())
    out = [F.coalesce(F.col(f"_p.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    keep = ["language", "manually_reviewed", "reviewed_by", "glossary_terms", "numbers", "segments"]
    return read.select("job_id", *out, *[F.col(f"_p.{k}") for k in keep], F.when(bad, "ARTIFACT_INVALID").alias("code"))


def segment_rows(decoded: DataFrame) -> DataFrame:
    """Nested segments -> rows of schemas.SEGMENTS; segment texts are stripped, word texts are not."""
    rows = decoded.select("job_id", F.posexplode("segments").alias("seq", "s"))
    none = F.array().cast("array<string>")
    return rows.select(
        "job_id", "seq", F.col("s.id").alias("id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), strip(F.col("s.text")).alias("text"), F.col("s.confidence").alias("confidence"),
        F.coalesce("s.uncertainty", none).alias("uncertainty"), F.coalesce("s.words", F.array().cast(f"array<{schemas.WORD}>")).alias("words"),
    )


def reference_status(decoded: DataFrame) -> DataFrame:
    """(job_id, code): whether a reference was reviewed by a named person and says anything."""
    said = F.exists("segments", lambda s: ~is_blank(s["text"]))
    code = (
        F.when(F.col("code").isNotNull(), "MANUAL_REFERENCE_INVALID")
        .when(~F.col("manually_reviewed").eqNullSafe(F.lit(True)) | F.coalesce(is_blank(F.col("reviewed_by")), F.lit(True)), "MANUAL_REFERENCE_UNVERIFIED")
        .when(~F.coalesce(said, F.lit(False)), "MANUAL_REFERENCE_EMPTY")
    )
    return decoded.select("job_id", code.alias("code"))


def _checked(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.when(c.isNotNull(), F.raise_error(F.lit("provider returned a non-finite number")).cast("double")))


def _heard(words: Column) -> Column:
    pick = lambda w: strip(F.coalesce(F.nullif(w["punctuated_word"], F.lit("")), F.nullif(w["word"], F.lit("")), F.lit("")))
    zero = lambda c: _checked(F.coalesce(c, F.lit(0.0)))
    return F.transform(F.coalesce(words, F.array().cast(f"array<{schemas.HEARD}>")), lambda w: F.struct(pick(w).alias("text"), zero(w["start"]).alias("start"), zero(w["end"]).alias("end"), _checked(w["confidence"]).alias("confidence")))


def parse_utterances(payloads: DataFrame, min_confidence: float, column: str = "payload") -> DataFrame:
    """Responses of utterances with words -> segments `dg-N` with uncertainty flags.

    Without utterances the first alternative of the first channel is one unflagged segment, if it
    has words. Non-finite numbers raise.
    """
    read = payloads.select("job_id", F.from_json(column, schemas.UTTERANCES, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("p"))
    rows = read.select("job_id", F.posexplode("p.results.utterances").alias("seq", "u"))
    words, conf, text = _heard(F.col("u.words")), _checked(F.col("u.confidence")), strip(F.coalesce("u.transcript", F.lit("")))
    flags = F.array_compact(F.array(F.when(F.col("u.confidence") < min_confidence, F.lit("low_segment_confidence")), F.when(F.exists("u.words", lambda w: w["confidence"] < min_confidence), F.lit("low_word_confidence")), F.when(F.length(text) == 0, F.lit("empty_segment"))))
    zero = lambda c: _checked(F.coalesce(F.col(c), F.lit(0.0)))
    spoken = rows.select("job_id", "seq", F.concat(F.lit("dg-"), F.col("seq") + 1).alias("id"), zero("u.start").alias("start"), zero("u.end").alias("end"), text.alias("text"), conf.alias("confidence"), flags.alias("uncertainty"), words.alias("words"))
    alone = read.filter(F.coalesce(F.size("p.results.utterances"), F.lit(0)) < 1).select("job_id", F.get(F.get("p.results.channels", F.lit(0))["alternatives"], F.lit(0)).alias("a")).filter("size(a.words) > 0")
    said = F.col("a.words")
    one = alone.select(
        "job_id", F.lit(0).alias("seq"), F.lit("dg-1").alias("id"), _checked(F.coalesce(F.get(said, F.lit(0))["start"], F.lit(0.0))).alias("start"), _checked(F.coalesce(F.element_at(said, -1)["end"], F.lit(0.0))).alias("end"),
        strip(F.coalesce("a.transcript", F.lit(""))).alias("text"), _checked(F.col("a.confidence")).alias("confidence"), F.array().cast("array<string>").alias("uncertainty"), _heard(said).alias("words"),
    )
    return spoken.union(one)


def parse_scored_segments(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Responses of segments with log probabilities -> segments `ow-N`; a text alone is one flagged segment."""
    read = payloads.select("job_id", F.from_json(column, schemas.SCORED_SEGMENTS, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("p"))
    rows = read.select("job_id", F.posexplode("p.segments").alias("seq", "s"))
    zero = lambda c: _checked(F.coalesce(F.col(c), F.lit(0.0)))
    logprob = _checked(F.col("s.avg_logprob"))
    flags = F.array_compact(F.array(F.when(logprob < -1.0, F.lit("low_log_probability")), F.when(zero("s.compression_ratio") > 2.4, F.lit("high_compression_ratio")), F.when(zero("s.no_speech_prob") > 0.6, F.lit("possible_silence"))))
    conf = F.when(F.col("s.avg_logprob").isNotNull(), F.exp(F.least(F.lit(0.0), logprob)))
    none = F.array().cast(f"array<{schemas.WORD}>").alias("words")
    spoken = rows.select("job_id", "seq", F.concat(F.lit("ow-"), F.col("seq") + 1).alias("id"), zero("s.start").alias("start"), zero("s.end").alias("end"), strip(F.coalesce("s.text", F.lit(""))).alias("text"), conf.alias("confidence"), flags.alias("uncertainty"), none)
    alone = read.filter((F.coalesce(F.size("p.segments"), F.lit(0)) < 1) & ~is_blank(F.coalesce("p.text", F.lit(""))))
    one = alone.select("job_id", F.lit(0).alias("seq"), F.lit("ow-1").alias("id"), F.lit(0.0).alias("start"), zero("p.duration").alias("end"), strip(F.col("p.text")).alias("text"), F.lit(None).cast("double").alias("confidence"), F.array(F.lit("missing_segment_timestamps")).alias("uncertainty"), none)
    return spoken.union(one)


def offset_segments(segments: DataFrame, offset: Column, prefix: Column) -> DataFrame:
    """Segments and their words moved by `offset`, ids led by `prefix-`."""
    moved = segments.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset, "id": F.concat(prefix, F.lit("-"), F.col("id"))})
    if "words" in segments.columns:
        moved = moved.withColumn("words", F.transform("words", lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset)))
    return moved


def merge_parts(parts: DataFrame) -> DataFrame:
    """Rows (job_id, part, seq, …) -> one sequence for each job, parts in order."""
    order = Window.partitionBy("job_id").orderBy("part", "seq")
    return parts.withColumn("seq", F.row_number().over(order) - 1).drop("part")


def chunk_plan(media: DataFrame, seconds: int = 600) -> DataFrame:
    """(job_id, duration) -> (job_id, part, offset, length): consecutive chunks of nominal length."""
    n = F.greatest(F.ceil(F.col("duration") / seconds), F.lit(1)).cast("int")
    rows = media.select("job_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return rows.select("job_id", "part", (F.col("part") * seconds).cast("double").alias("offset"), F.least(F.lit(float(seconds)), F.col("duration") - F.col("part") * seconds).alias("length"))


def clip_plan(media: DataFrame, positions: list[float], seconds: float) -> DataFrame:
    """(job_id, duration) -> (job_id, ordinal, start, length): representative clips around positions in [0, 1]."""
    length = F.least(F.lit(float(seconds)), F.col("duration") / len(positions))
    rows = media.select("job_id", "duration", F.posexplode(F.array(*[F.lit(float(p)) for p in positions])).alias("ordinal", "position"))
    at = F.least(F.greatest(F.col("position"), F.lit(0.0)), F.lit(1.0))
    start = F.least(F.greatest(F.lit(0.0), F.col("duration") * at - length / 2), F.greatest(F.lit(0.0), F.col("duration") - length))
    return rows.select("job_id", (F.col("ordinal") + 1).alias("ordinal"), F.bround(start, 3).alias("start"), F.bround(length, 3).alias("length"))


def validate_segments(segments: DataFrame, media: DataFrame, language: Column | None = None, expected_language: str = "pt-BR") -> DataFrame:
    """(job_id, seq, rule) violations of a transcript; `media` has (job_id, duration).

    One window over (job_id, seq) and one over (job_id, id); rules that Python's comparisons leave
    untouched by NaN are guarded by finite().
    """
    rows = segments.join(media.select("job_id", F.col("duration").alias("_d")), "job_id")
    by_seq = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    by_id = Window.partitionBy("job_id", "id").orderBy("seq")
    timed = finite(F.col("start")) & finite(F.col("end"))
    inside = timed & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("_d") + 1.0)
    rows = rows.withColumn("_inside", inside).withColumn("_before", F.coalesce(F.max(F.when(F.col("_inside"), F.col("start"))).over(by_seq), F.lit(-1.0))).withColumn("_again", F.row_number().over(by_id) > 1)
    conf = F.col("confidence")
    found = [
        F.when(F.col("_again"), F.lit("duplicate identifier")),
        F.when(is_blank(F.col("text")), F.lit("empty text")),
        F.when(~timed, F.lit("non-finite timing")).when(~F.col("_inside"), F.lit("invalid media bounds")).when(F.col("start") < F.col("_before"), F.lit("out-of-order timing")),
        F.when(conf.isNotNull() & ~(finite(conf) & conf.between(0, 1)), F.lit("invalid confidence")),
    ]
    rules = F.array_compact(F.array(*found))
    if "words" in segments.columns:
        good = lambda w: finite(w["start"]) & finite(w["end"]) & (w["start"] >= 0) & (w["end"] > w["start"]) & (w["end"] <= F.col("_d") + 1.0)
        each = lambda bad, rule: F.transform(F.filter("words", bad), lambda w: F.lit(rule))
        rules = F.concat(rules, each(lambda w: ~good(w), "invalid word timing"), each(lambda w: is_blank(w["text"]), "empty word"), each(lambda w: w["confidence"].isNotNull() & ~(finite(w["confidence"]) & w["confidence"].between(0, 1)), "invalid word confidence"))
    if language is not None:
        rules = F.concat(F.when((language != expected_language) & (F.col("seq") == 0), F.array(F.lit("language mismatch"))).otherwise(F.array().cast("array<string>")), rules)
    return rows.select("job_id", "seq", F.explode(rules).alias("rule"))


def flag_low_confidence(segments: DataFrame, minimum: float) -> DataFrame:
    """low_segment_confidence added where a valid confidence is below the minimum."""
    c = F.col("confidence")
    low = finite(c) & c.between(0, 1) & (c < minimum)
    return segments.withColumn("uncertainty", F.when(low, F.array_union("uncertainty", F.array(F.lit("low_segment_confidence")))).otherwise(F.col("uncertainty")))
