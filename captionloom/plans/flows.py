"""Whole flows over many jobs: each takes and returns DataFrames, nothing runs until a result is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.functions.text import to_ms
from captionloom.operators import cues, intervals, metrics, transcripts, translation
from captionloom.sources import captions, providers


@dataclass
class Transcribed:
    segments: DataFrame
    violations: DataFrame
    report: DataFrame


def _report(segments: DataFrame, violations: DataFrame) -> DataFrame:
    """(job_id, status, segment_count, uncertain_segment_count, violation_count)"""
    s = segments.groupBy("job_id").agg(F.count("*").alias("segment_count"), F.count_if(F.size("uncertainty") > 0).alias("uncertain_segment_count"))
    v = violations.groupBy("job_id").agg(F.count("*").alias("violation_count"))
    both = s.join(v, "job_id", "left").na.fill(0, ["violation_count"])
    return both.select("job_id", F.when(F.col("violation_count") == 0, "PASS").otherwise("BLOCKED").alias("status"), "segment_count", "uncertain_segment_count", "violation_count")


def transcribe(chunks: DataFrame, media: DataFrame, recogniser: providers.Recogniser, parse, minimum_confidence: float = 0.65, language: str = "pt-BR") -> Transcribed:
    """Chunks (job_id, part, offset, path) through a recogniser to checked segments of whole jobs.

    `parse` turns (job_id, payload) into segments, e.g. transcripts.parse_scored_segments; a chunk is a
    job of its own there, so ids stay apart until the parts are merged in order.
    """
    heard = providers.recognise(chunks, recogniser, language, minimum_confidence)
    keyed = heard.select(F.to_json(F.struct("job_id", "part", "offset")).alias("job_id"), "payload")
    parts = parse(keyed).withColumn("_k", F.from_json("job_id", "job_id string, part int, offset double"))
    parts = parts.select(F.col("_k.job_id").alias("job_id"), F.col("_k.part").alias("part"), F.col("_k.offset").alias("_offset"), *[c for c in parts.columns if c not in ("job_id", "_k")])
    moved = transcripts.offset_segments(parts, F.col("_offset"), F.concat(F.lit("part"), (F.col("part") + 1).cast("string"))).drop("_offset")
    whole = transcripts.flag_low_confidence(transcripts.merge_parts(moved), minimum_confidence)
    found = transcripts.validate_segments(whole, media)
    return Transcribed(whole, found, _report(whole, found))


def bake_off(reference: DataFrame, candidates: DataFrame, terms: DataFrame, expected_numbers: DataFrame, clips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluations with gates and scores, winners). With `clips` (job_id, start, length), native tracks are cut to what overlaps them."""
    if clips is not None:
        windows = clips.select("job_id", to_ms(F.col("start")).alias("from"), to_ms(F.col("start") + F.col("length")).alias("to"))
        native = intervals.overlapping(candidates.filter("candidate = 'native'"), windows, "job_id")
        candidates = candidates.filter("candidate != 'native'").unionByName(native)
    judged = metrics.gated(metrics.evaluate(reference, candidates, terms, expected_numbers))
    return judged, metrics.select_winner(judged)


def translate(segments: DataFrame, translator: providers.Translator, terms: list[str], batch_size: int = 40, minimum_coverage: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(translations, violations): batches through a translator, in the source's order, checked against it."""
    made = providers.translate(translation.batches(segments, batch_size), translator, "pt-BR", "en", terms)
    items = made.groupBy("job_id").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "text", "uncertain", "notes")).alias("translations"))).alias("payload"))
    done = translation.decode_results(items, segments)
    found = translation.validate_translation(segments, done, terms)
    short = translation.coverage(segments, done).filter(F.col("coverage") < minimum_coverage).select("job_id", F.lit(None).cast("int").alias("seq"), F.lit("translation coverage below minimum").alias("rule"))
    return done, found.union(short)


@dataclass
class Subtitled:
    cues: DataFrame
    violations: DataFrame
    coverage: DataFrame
    srt: DataFrame
    vtt: DataFrame


def subtitle(translations: DataFrame, media: DataFrame, policy: cues.Policy) -> Subtitled:
    """Cues of each job with what is wrong with them, and both caption files."""
    made = cues.build_cues(translations, media, policy)
    timed = made.select("job_id", "index", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "text")
    return Subtitled(made, cues.validate_cues(made, media, policy), cues.text_coverage(translations, made), captions.render_srt(timed, ["job_id"], media), captions.render_vtt(timed, ["job_id"], media))
