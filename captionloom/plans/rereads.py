"""What a stage reads back of the stages before it: rows with a stable code where something is missing or wrong.

`files` has (job_id, path, content): what is there of the jobs' artifacts. `jobs` has (job_id), and each
of its jobs has one row in a result's codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom import schemas
from captionloom.functions.text import is_blank
from captionloom.sources import captions

#: Where the artifacts are.
CLIPS, REFERENCE, TRANSLATION, SUBTITLES = "audio/eval-clips.json", "asr/reference.json", "translation/en.json", "subtitles/en.srt"
SOFT_OUTPUTS = ("output/soft-subtitled.mp4", "output/soft-subtitled.mkv")

CLIP = "struct<ordinal: int, path: string, start: double, duration: double, sha256: string>"
TRANSLATED = "struct<id: string, start: double, end: double, source_text: string, text: string, uncertainty: array<string>, notes: string>"


def _one(jobs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """jobs with `content` of the artifact, null where there is none."""
    return jobs.select("job_id").join(files.filter(F.col("path") == path).select("job_id", "content"), "job_id", "left")


def _listed(content: Column, name: str, kind: str) -> Column:
    return F.from_json(content, f"struct<{name}: array<{kind}>>")[name]


def _is_object(content: Column) -> Column:
    return F.from_json(content, "map<string,string>").isNotNull()


def passing(jobs: DataFrame, files: DataFrame, path: str, code: str) -> DataFrame:
    """(job_id, code): the given code for jobs whose report at `path` is not PASS; ARTIFACT_INVALID without a JSON object there."""
    text = F.from_json("content", "map<string,string>")
    status = F.try_element_at(text, F.lit("status"))
    return _one(jobs, files, path).select("job_id", F.when(text.isNull(), "ARTIFACT_INVALID").when(status.eqNullSafe(F.lit("PASS")), None).otherwise(code).alias("code"))


def clip_records(jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((job_id, ordinal, path, start, duration, sha256), (job_id, code)): the evaluation clips, EVAL_CLIPS_MISSING where there are none, ARTIFACT_INVALID without a JSON object."""
    read = _one(jobs, files, CLIPS).select("job_id", _is_object(F.col("content")).alias("ok"), _listed(F.col("content"), "clips", CLIP).alias("c"))
    code = F.when(~F.col("ok"), "ARTIFACT_INVALID").when(F.coalesce(F.size("c"), F.lit(0)) <= 0, "EVAL_CLIPS_MISSING")
    return read.select("job_id", F.explode("c").alias("c")).select("job_id", "c.*"), read.select("job_id", code.alias("code"))


def translations(jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schemas.TRANSLATIONS, (job_id, code)): TRANSLATION_MISSING without a file, ARTIFACT_INVALID without a JSON object, TRANSLATION_INVALID where a segment lacks a field."""
    read = _one(jobs, files, TRANSLATION).select("job_id", "content", _listed(F.col("content"), "segments", TRANSLATED).alias("s"))
    bad = F.exists("s", lambda x: x["id"].isNull() | x["start"].isNull() | x["end"].isNull() | x["text"].isNull())
    code = F.when(F.col("content").isNull(), "TRANSLATION_MISSING").when(~_is_object(F.col("content")), "ARTIFACT_INVALID").when(F.coalesce(bad, F.lit(False)), "TRANSLATION_INVALID")
    coded = read.withColumn("code", code)
    rows = coded.filter("code is null").select("job_id", F.posexplode("s").alias("seq", "s"))
    none = F.array().cast("array<string>")
    return rows.select("job_id", "seq", "s.id", "s.start", "s.end", F.coalesce("s.source_text", F.lit("")).alias("source_text"), "s.text", F.coalesce("s.uncertainty", none).alias("uncertainty"), F.coalesce("s.notes", F.lit("")).alias("notes")), coded.select("job_id", "code")


def cues(jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues as captions.parse_srt() gives them, (job_id, code)): SUBTITLES_MISSING without a file, SUBTITLES_EMPTY without a cue."""
    read = _one(jobs, files, SUBTITLES)
    rows = captions.parse_srt(read.filter("content is not null"), ["job_id"])
    counted = read.join(rows.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left")
    return rows, counted.select("job_id", F.when(F.col("content").isNull(), "SUBTITLES_MISSING").when(F.col("n").isNull(), "SUBTITLES_EMPTY").alias("code"))


def glossary_terms(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, term) of the reviewed reference; a job without one has none."""
    return _one(jobs, files, REFERENCE).select("job_id", F.explode(_listed(F.col("content"), "glossary_terms", "string")).alias("term")).filter("term is not null")


def soft_outputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, path, code): the one rendered file with soft subtitles; SOFT_OUTPUT_MISSING unless there is exactly one."""
    have = files.filter(F.col("path").isin(*SOFT_OUTPUTS)).groupBy("job_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    one = F.col("n").eqNullSafe(F.lit(1))
    return jobs.select("job_id").join(have, "job_id", "left").select("job_id", F.when(one, F.col("path")).alias("path"), F.when(~one, "SOFT_OUTPUT_MISSING").alias("code"))


def native_segments(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, id, start, end, text, ..., source) as in schemas.SEGMENTS: a video's own captions as a transcript.

    `files` has (keys, path, content); a path that ends in .vtt is WebVTT, any other SRT. Blank cues and
    those without times say nothing and are left out. Ids are native-<index>, times seconds.
    """
    vtt = F.lower(F.col("path")).endswith(".vtt")
    read = captions.parse_vtt(files.filter(vtt), keys).unionByName(captions.parse_srt(files.filter(~vtt), keys))
    said = read.filter(~is_blank(F.col("text")) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return said.select(
        *keys, "seq", F.concat(F.lit("native-"), F.col("index").cast("string")).alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text",
        F.lit(None).cast("double").alias("confidence"), empty("string").alias("uncertainty"), empty(schemas.WORD).alias("words"), F.lit("native_caption").alias("source"),
    )


def bake_off_status(evaluations: DataFrame, attempts: DataFrame) -> DataFrame:
    """(job_id, candidate, status): what became of every candidate.

    `attempts` has (job_id, candidate, outcome): `unavailable` ones are excluded, `failed` ones failed;
    the others are as `evaluations` (metrics.gated()) judges them, and excluded if it does not.
    """
    judged = evaluations.select("job_id", "candidate", F.col("status").alias("_judged"))
    status = F.when(F.col("outcome") == "unavailable", "excluded").when(F.col("outcome") == "failed", "failed").otherwise(F.coalesce("_judged", F.lit("excluded")))
    return attempts.join(judged, ["job_id", "candidate"], "left").select("job_id", "candidate", status.alias("status"))


def bake_off(evaluations: DataFrame, attempts: DataFrame) -> DataFrame:
    """(job_id, selected, code) for each job of `attempts`: the winner among what was evaluated, see metrics.select_winner()."""
    from captionloom.operators import metrics

    tried = bake_off_status(evaluations, attempts).filter(F.col("status").isin("eligible", "rejected")).select("job_id", "candidate")
    chosen = metrics.select_winner(evaluations.join(tried, ["job_id", "candidate"], "left_semi"))
    jobs = attempts.select("job_id").distinct().join(chosen, "job_id", "left")
    return jobs.select("job_id", "selected", F.when(F.col("selected").isNull(), F.coalesce("code", F.lit("ASR_CANDIDATES_INSUFFICIENT"))).alias("code"))
