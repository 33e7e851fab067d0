"""The stages from normalizing to the manifest, for many jobs at once: each turns artifacts into artifacts or into codes.

A stage takes the jobs to do (job_id) and the artifacts there are (job_id, path, content), and returns rows
(job_id, path, content, code): what it made, and under which code it blocks a job. One job's bad input,
a provider's failure or a response that is no JSON is a row like any other; the other jobs go on.

Effects come from outside: facts and probes of media files as tables, recogniser and translator as functions
that executors call. Artifacts are kept in a written table, so that a stage reads what was there before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom import schemas
from captionloom.functions.text import to_ms
from captionloom.operators import cues as cue_ops
from captionloom.operators import evidence, transcripts, translation
from captionloom.plans import ledger, rereads
from captionloom.plans.engine import ProviderError, ProviderUnavailable, Stage
from captionloom.sources import captions

RECEIPT, AUDIO, TRANSCRIPT, EVALUATION = "source/discovery.json", "audio/normalized.json", "transcript/pt-BR.raw.json", "asr/evaluation.json"
TRANSCRIPT_REPORT, TRANSLATION_REPORT, SUBTITLE_REPORT, REPORT, MANIFEST = "transcript/validation.json", "translation/validation.json", "subtitles/validation.json", "validation/report.json", "output/manifest.json"
CUES, VTT, SOFT, BURNED = "subtitles/cues.json", "subtitles/en.vtt", "output/soft-subtitled.mp4", "output/burned-in.mp4"

RECEIPT_SHAPE = "struct<status: string, transport: string, source_path: string, bytes: bigint, sha256: string>"
FILES = "job_id string, path string, content string"
ROWS = "job_id string, path string, content string, code string"


class Artifacts:
    """Jobs' text artifacts as a written table; of each path the newest counts, and a null content takes it away."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, rows: DataFrame, order: int) -> None:
        """Append artifacts (job_id, path, content) under a place in the order; writing a place again replaces it."""
        rows.select("job_id", "path", "content", F.lit(order).alias("place")).write.mode("overwrite").parquet(f"{self.folder}/{order:06}")

    def files(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{FILES}, place int").option("recursiveFileLookup", "true").parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], FILES)
        newest = rows.groupBy("job_id", "path").agg(F.max_by(F.struct("content"), "place").alias("f"))
        return newest.select("job_id", "path", "f.content").filter("content is not null")

    def present(self, spark: SparkSession) -> DataFrame:
        """(job_id, path, sha256), as an Engine asks for it."""
        return self.files().select("job_id", "path", F.sha2("content", 256).alias("sha256"))


@dataclass
class JobStages:
    """The stages of jobs whose media are known by tables.

    `media` has (job_id, path, bytes, sha256, writable) of the source files, `probes` (job_id, probe) the
    media tool's JSON of each source, `rendered` (job_id, path, bytes, sha256, duration, streams) the
    rendered outputs, and `frames` (job_id, side, ordinal, path, sha256, width, height, pixels) the frames
    sampled of source and burned output. `audio` has (job_id, part, path), where each chunk's audio is;
    without it the chunks are <job_id>/audio/part<number>.flac.
    """

    media: DataFrame
    probes: DataFrame
    rendered: DataFrame
    frames: DataFrame
    recogniser: Callable
    translator: Callable
    audio: DataFrame | None = None
    terms: list[str] = field(default_factory=list)
    policy: cue_ops.Policy = field(default_factory=cue_ops.Policy)
    minimum_confidence: float = 0.65
    chunk_seconds: int = 600
    batch_size: int = 40
    minimum_ratio: float = evidence.MINIMUM_RATIO
    #: Where a running stage keeps what it uses more than once; set by stages().
    folder: str | None = None

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, written and read back: what a provider answered is asked for once, and plans stay short."""
        if self.folder is None:
            return rows
        path = f"{self.folder}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def normalize(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """The source's receipt against what is there, and its length; media without one are a MEDIA_FAILURE."""
        read = _one(jobs, files, RECEIPT).select("job_id", F.from_json("content", RECEIPT_SHAPE).alias("r")).select("job_id", "r.*")
        coded = ledger.receipt_codes(read, self.media)
        lengths = ledger.media_durations(self.probes)
        both = jobs.join(coded, "job_id", "left").join(lengths, "job_id", "left").withColumn("code", F.coalesce("code", F.when(F.col("duration").isNull(), "MEDIA_FAILURE")))
        return _rows(_artifact(both.filter("code is null"), AUDIO, F.struct("duration", "width", "height")), both)

    def transcribe(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """Chunks of the audio through the recogniser to one checked transcript of each job."""
        audio, coded = self._audio(jobs, files)
        chunks = transcripts.chunk_plan(audio, self.chunk_seconds)
        if self.audio is None:
            chunks = chunks.withColumn("path", F.concat("job_id", F.lit("/audio/part"), F.col("part") + 1, F.lit(".flac")))
        else:
            chunks = chunks.join(self.audio.select("job_id", "part", "path"), ["job_id", "part"], "left")
        heard = self._kept(asked(chunks, self.recogniser, self.minimum_confidence), "heard")
        failed = heard.filter("code is not null").groupBy("job_id").agg(F.min("code").alias("code"))
        fine = heard.join(failed, "job_id", "left_anti")
        keyed = fine.select(F.to_json(F.struct("job_id", "part", "offset")).alias("job_id"), "payload")
        parts = transcripts.parse_scored_segments(keyed).withColumn("_k", F.from_json("job_id", "job_id string, part int, offset double"))
        parts = parts.select(F.col("_k.job_id").alias("job_id"), F.col("_k.part").alias("part"), F.col("_k.offset").alias("_offset"), *[c for c in parts.columns if c not in ("job_id", "_k")])
        moved = transcripts.offset_segments(parts, F.col("_offset"), F.concat(F.lit("part"), (F.col("part") + 1).cast("string"))).drop("_offset")
        whole = self._kept(transcripts.flag_low_confidence(transcripts.merge_parts(moved), self.minimum_confidence), "segments")
        wrong = transcripts.validate_segments(whole, audio)
        counts = whole.groupBy("job_id").agg(F.count("*").alias("segment_count"), F.count_if(F.size("uncertainty") > 0).alias("uncertain_segment_count"))
        judged = jobs.join(coded.withColumnRenamed("code", "_before"), "job_id", "left").join(failed.withColumnRenamed("code", "_failed"), "job_id", "left").join(counts, "job_id", "left").join(_counted(wrong), "job_id", "left")
        code = F.coalesce("_before", "_failed", F.when(F.col("segment_count").isNull(), "TRANSCRIPT_EMPTY"), F.when(F.col("violation_count") > 0, "TRANSCRIPT_VALIDATION_FAILED"))
        judged = self._kept(judged.withColumn("code", code), "judged")
        with_text = judged.filter("segment_count is not null")
        text = _listed(whole, "seq", "id", "start", "end", "text", "confidence", "uncertainty", "words")
        raw = _artifact(text.join(with_text.select("job_id"), "job_id", "left_semi"), TRANSCRIPT, F.struct(F.lit(1).alias("schema_version"), F.lit("pt-BR").alias("language"), F.col("items").alias("segments")))
        report = _artifact(with_text, TRANSCRIPT_REPORT, F.struct(_status(), "segment_count", "uncertain_segment_count", F.coalesce("violation_count", F.lit(0)).alias("violation_count")))
        passed = _artifact(judged.filter("code is null"), EVALUATION, F.struct(F.lit("PASS").alias("status"), F.lit("single").alias("mode")))
        return _rows(raw.union(report).union(passed), judged)

    def translate(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """The transcript in batches through the translator, checked against it."""
        gate = rereads.passing(jobs, files, TRANSCRIPT_REPORT, "TRANSCRIPT_NOT_VALIDATED")
        decoded = transcripts.decode_transcripts(_one(jobs, files, TRANSCRIPT).withColumnRenamed("content", "payload"))
        coded = gate.join(decoded.select("job_id", F.when(F.col("code").isNotNull(), "TRANSCRIPT_INVALID").alias("_shape")), "job_id").select("job_id", F.coalesce("code", "_shape").alias("_before"))
        source = self._kept(transcripts.segment_rows(decoded.join(coded.filter("_before is null"), "job_id", "left_semi")), "source")
        got = self._kept(translated(translation.batches(source, self.batch_size), self.translator, self.terms), "translated")
        failed = got.filter("code is not null").groupBy("job_id").agg(F.min("code").alias("_failed"))
        open_ = source.join(failed, "job_id", "left_anti")
        done = self._kept(translation.decode_results(_payloads(got.join(failed, "job_id", "left_anti")), open_), "done")
        refused = done.filter("code is not null").select("job_id", F.col("code").alias("_refused")).distinct()
        wrong = translation.validate_translation(open_.join(refused, "job_id", "left_anti"), done.join(refused, "job_id", "left_anti"), self.terms)
        judged = jobs.join(coded, "job_id", "left").join(failed, "job_id", "left").join(refused, "job_id", "left").join(_counted(wrong), "job_id", "left")
        judged = self._kept(judged.withColumn("code", F.coalesce("_before", "_failed", "_refused", F.when(F.col("violation_count") > 0, "TRANSLATION_VALIDATION_FAILED"))), "judged")
        made = judged.filter(F.coalesce("_before", "_failed", "_refused").isNull())
        text = _listed(done, "seq", "id", "start", "end", "source_text", "text", "uncertainty", "notes").join(made.select("job_id"), "job_id", "left_semi")
        return _rows(_artifact(text, rereads.TRANSLATION, F.struct(F.col("items").alias("segments"))).union(_artifact(made, TRANSLATION_REPORT, F.struct(_status(), F.coalesce("violation_count", F.lit(0)).alias("violation_count")))), judged)

    def subtitles(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """Cues of the translation after the policy, and both caption files."""
        gate = rereads.passing(jobs, files, TRANSLATION_REPORT, "TRANSLATION_NOT_VALIDATED")
        rows, shapes = rereads.translations(jobs, files)
        audio, lengths = self._audio(jobs, files)
        coded = gate.join(shapes.withColumnRenamed("code", "_shape"), "job_id").join(lengths.withColumnRenamed("code", "_length"), "job_id").select("job_id", F.coalesce("code", "_shape", "_length").alias("_before"))
        open_ = self._kept(rows.join(coded.filter("_before is null"), "job_id", "left_semi"), "translations")
        made = self._kept(cue_ops.build_cues(open_, audio, self.policy), "cues")
        wrong = cue_ops.validate_cues(made, audio, self.policy)
        counts = made.groupBy("job_id").agg(F.count("*").alias("cue_count"))
        covered = cue_ops.text_coverage(open_, made)
        judged = jobs.join(coded, "job_id", "left").join(counts, "job_id", "left").join(_counted(wrong), "job_id", "left").join(covered, "job_id", "left")
        bad = (F.coalesce("violation_count", F.lit(0)) > 0) | ~F.coalesce("covered", F.lit(False))
        judged = self._kept(judged.withColumn("code", F.coalesce("_before", F.when(bad, "SUBTITLE_POLICY_FAILED"))), "judged")
        report = _artifact(judged.filter("_before is null"), SUBTITLE_REPORT, F.struct(_status(), F.coalesce("cue_count", F.lit(0)).alias("cue_count"), F.coalesce("violation_count", F.lit(0)).alias("violation_count")))
        fine = judged.filter("code is null").select("job_id")
        timed = made.join(fine, "job_id", "left_semi").select("job_id", "index", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "text")
        out = report.union(_artifact(_listed(made, "index", "start", "end", "text").join(fine, "job_id", "left_semi"), CUES, F.struct(F.col("items").alias("cues"))))
        for path, text in ((rereads.SUBTITLES, captions.render_srt(timed, ["job_id"], fine)), (VTT, captions.render_vtt(timed, ["job_id"], fine))):
            out = out.union(text.select("job_id", F.lit(path).alias("path"), "content"))
        return _rows(out, judged)

    def render(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """The rendered outputs there are of each job, soft and burned, as probes; a job without both is a MEDIA_FAILURE."""
        gate = rereads.passing(jobs, files, SUBTITLE_REPORT, "SUBTITLES_NOT_VALIDATED")
        _, shapes = rereads.cues(jobs, files)
        have = self.rendered.groupBy("job_id").agg(F.collect_set("path").alias("_paths"))
        judged = jobs.join(gate.withColumnRenamed("code", "_gate"), "job_id").join(shapes.withColumnRenamed("code", "_shape"), "job_id").join(have, "job_id", "left")
        both = F.array_contains("_paths", SOFT) & F.array_contains("_paths", BURNED)
        judged = judged.withColumn("code", F.coalesce("_gate", "_shape", F.when(~F.coalesce(both, F.lit(False)), "MEDIA_FAILURE")))
        facts = self.rendered.join(judged.filter("code is null"), "job_id", "left_semi")
        return _rows(facts.select("job_id", "path", F.to_json(F.struct("bytes", "sha256", "duration")).alias("content")), judged)

    def validate(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """Streams and lengths of the outputs, equality of both caption files, and the overlay's evidence in frames."""
        _, shapes = rereads.cues(jobs, files)
        soft = rereads.soft_outputs(jobs, files).select("job_id", F.col("code").alias("_soft"))
        burned = _one(jobs, files, BURNED).select("job_id", F.when(F.col("content").isNull(), "BURNED_OUTPUT_MISSING").alias("_burned"))
        probe = F.from_json("probe", schemas.PROBE)
        streams = F.transform(probe["streams"], lambda s: F.struct(s["codec_type"].alias("codec_type"), s["codec_name"].alias("codec_name"), s["tags"]["language"].alias("language")))
        source = self.probes.select("job_id", streams.alias("streams")).join(ledger.media_durations(self.probes).select("job_id", "duration"), "job_id").join(jobs, "job_id", "left_semi")
        outputs = self.rendered.join(jobs, "job_id", "left_semi").select("job_id", F.when(F.col("path") == SOFT, "soft").otherwise("burned").alias("output"), "duration", "streams")
        wrong = ledger.output_checks(outputs, source).select("job_id", "rule")
        srt, vtt = (files.filter(F.col("path") == p).join(jobs, "job_id", "left_semi") for p in (rereads.SUBTITLES, VTT))
        same = captions.parity(captions.parse_srt(srt, ["job_id"]), captions.parse_vtt(vtt, ["job_id"]), ["job_id"])
        wrong = wrong.union(same.filter("not equal").select("job_id", F.lit("captions differ").alias("rule")))
        mine = self.frames.join(jobs, "job_id", "left_semi")
        side = lambda name: mine.filter(F.col("side") == name)
        wrong = wrong.union(evidence.frame_gate(jobs, side("source"), side("burned"), self.minimum_ratio))
        judged = jobs.join(shapes.withColumnRenamed("code", "_shape"), "job_id").join(soft, "job_id").join(burned, "job_id").join(_counted(wrong, rules=True), "job_id", "left")
        judged = self._kept(judged.withColumn("code", F.coalesce("_soft", "_burned", "_shape", F.when(F.col("violation_count") > 0, "OUTPUT_VALIDATION_FAILED"))), "judged")
        ratios = evidence.compare_frames(side("source"), side("burned")).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ratio"))).alias("r")).select("job_id", F.col("r.ratio").alias("_ratios"))
        records = lambda name, to: side(name).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "sha256"))).alias("f")).select("job_id", F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"))).alias(to))
        told = judged.filter(F.coalesce("_soft", "_burned", "_shape").isNull()).join(records("burned", "_frames"), "job_id", "left").join(records("source", "_sources"), "job_id", "left").join(ratios, "job_id", "left")
        body = F.struct(F.when(F.col("code").isNull(), "PASS").otherwise("BLOCKED").alias("quality_status"), F.col("_frames").alias("sampled_frames"), F.col("_sources").alias("source_sampled_frames"), F.col("_ratios").alias("burned_lower_frame_difference_ratio"), F.coalesce("rules", F.array().cast("array<string>")).alias("violations"))
        return _rows(_artifact(told, REPORT, body), judged)

    def manifest(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """The whole contract checked against files on hand; a job that keeps it gets its manifest."""
        have = files.join(jobs, "job_id", "left_semi")
        media = self.media.join(jobs, "job_id", "left_semi").select("job_id", "path", "bytes", "sha256")
        frames = self.frames.join(jobs, "job_id", "left_semi").select("job_id", "path", F.octet_length("pixels").cast("bigint").alias("bytes"), "sha256")
        hashed = have.select("job_id", "path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256")).unionByName(media).unionByName(frames)
        breaches = evidence.manifest_contract(jobs, hashed, have, minimum=self.minimum_ratio)
        order = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in ("QUALITY_NOT_PASSING", "VALIDATION_EVIDENCE_INVALID", "COMPLETION_ARTIFACT_MISSING")]), F.array(*[F.lit(k) for k in range(3)])), F.col("code"))
        first = breaches.groupBy("job_id").agg(F.min_by("code", order).alias("code"))
        judged = jobs.join(first, "job_id", "left")
        listed = hashed.groupBy("job_id").agg(F.array_sort(F.collect_set(F.struct("path", "bytes", "sha256"))).alias("artifacts")).join(judged.filter("code is null"), "job_id", "left_semi")
        return _rows(_artifact(listed, MANIFEST, F.struct(F.lit(1).alias("schema_version"), F.lit("COMPLETE").alias("status"), "artifacts")), judged)

    def _audio(self, jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((job_id, duration), (job_id, code)): the normalized audio, NORMALIZED_AUDIO_MISSING without it."""
        read = _one(jobs, files, AUDIO).select("job_id", F.from_json("content", "struct<duration: double>")["duration"].alias("duration"))
        return read.filter("duration is not null"), read.select("job_id", F.when(F.col("duration").isNull(), "NORMALIZED_AUDIO_MISSING").alias("code"))

    def stages(self, artifacts: Artifacts, first: int = 1) -> dict[str, Stage]:
        """The stages as an Engine runs them: artifacts are written to the table, records get their hashes."""
        names = ("normalize", "transcribe", "translate", "subtitles", "render", "validate", "manifest")

        def bound(name: str, place: int) -> Stage:
            def run(spark: SparkSession, jobs: DataFrame) -> DataFrame:
                own = replace(self, folder=f"{artifacts.folder}-kept/{place:06}")
                made = getattr(own, name)(jobs, own._kept(artifacts.files(), "files"))
                path = f"{artifacts.folder}-made/{place:06}"
                made.write.mode("overwrite").parquet(path)
                made = spark.read.schema(ROWS).parquet(path)
                artifacts.add(made.filter("path is not null"), place)
                return made.select("job_id", "path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"), "code")

            return run

        return {name: bound(name, first + k) for k, name in enumerate(names)}


def _one(jobs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return jobs.select("job_id").join(files.filter(F.col("path") == path).select("job_id", "content"), "job_id", "left")


def _status() -> Column:
    return F.when(F.col("code").isNull(), "PASS").otherwise("BLOCKED").alias("status")


def _artifact(rows: DataFrame, path: str, value: Column) -> DataFrame:
    return rows.select("job_id", F.lit(path).alias("path"), F.to_json(value).alias("content"))


def _listed(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """(job_id, items): the rows of each job as a list in order, to be written as one artifact."""
    made = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*dict.fromkeys((*([order] if order == "index" else []), *columns))).alias("item")))).alias("l"))
    return made.select("job_id", F.col("l.item").alias("items"))


def _counted(violations: DataFrame, rules: bool = False) -> DataFrame:
    more = [F.array_sort(F.collect_list("rule")).alias("rules")] if rules else []
    return violations.groupBy("job_id").agg(F.count("*").alias("violation_count"), *more)


def _rows(artifacts: DataFrame, judged: DataFrame) -> DataFrame:
    """A stage's rows: artifacts, and a row for each job that is blocked; a job of neither still has a row."""
    none = F.lit(None).cast("string")
    made = artifacts.select("job_id", "path", "content", none.alias("code"))
    return made.union(judged.select("job_id", none.alias("path"), none.alias("content"), F.col("code").cast("string").alias("code")))


def _code(error: Exception) -> str:
    return "PROVIDER_UNAVAILABLE" if isinstance(error, ProviderUnavailable) else "PROVIDER_FAILURE" if isinstance(error, ProviderError) else "INTERNAL_FAILURE"


def _refuse(constant: str) -> float:
    raise ValueError(constant)


def response(text: object) -> str:
    """A recogniser's response if it is a JSON object of finite numbers, which is all that parsers take."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (TypeError, ValueError) as e:
        raise ProviderError("the response is no JSON") from e
    segments = value.get("segments") if isinstance(value, dict) else None
    if not isinstance(value, dict) or not isinstance(segments or [], list) or not all(isinstance(s, dict) for s in segments or []):
        raise ProviderError("the response has another shape")
    for s in segments or []:
        for key in ("start", "end", "avg_logprob", "compression_ratio", "no_speech_prob"):
            if not (s.get(key) is None or isinstance(s[key], (int, float)) and not isinstance(s[key], bool) and math.isfinite(s[key])):
                raise ProviderError("a number is none")
        if not isinstance(s.get("text"), (str, type(None))) or not isinstance(s.get("id"), (int, type(None))):
            raise ProviderError("a text is none")
    return text


def asked(chunks: DataFrame, provider: Callable, minimum_confidence: float, language: str = "pt-BR") -> DataFrame:
    """(job_id, part, offset, path) -> (job_id, part, offset, payload, code): one call a chunk on the executors, failures as codes."""

    def run(batches):
        for b in batches:
            out = []
            for job, part, offset, path in zip(b["job_id"], b["part"], b["offset"], b["path"], strict=True):
                try:
                    out.append((job, part, offset, response(provider(path, language=language, min_confidence=minimum_confidence)), None))
                except Exception as e:  # whatever a provider raises is its chunk's alone
                    out.append((job, part, offset, None, _code(e)))
            yield pd.DataFrame(out, columns=["job_id", "part", "offset", "payload", "code"])

    return chunks.select("job_id", "part", "offset", "path").mapInPandas(run, "job_id string, part int, offset double, payload string, code string")


def translated(batched: DataFrame, provider: Callable, terms: list[str]) -> DataFrame:
    """Segments with `batch` -> (job_id, batch, id, text, uncertain, notes, code): one call a batch, failures as a row with a code."""
    columns = ["job_id", "batch", "id", "text", "uncertain", "notes", "code"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        job, batch = pdf["job_id"].iloc[0], int(pdf["batch"].iloc[0])
        try:
            got = provider(pdf[["id", "text"]].to_dict("records"), source_language="pt-BR", target_language="en", terms=terms)
            rows = [(job, batch, str(g["id"]), str(g["text"]), bool(g.get("uncertain")), str(g.get("notes", "")), None) for g in got]
        except Exception as e:  # as in asked()
            rows = [(job, batch, None, None, None, None, _code(e))]
        return pd.DataFrame(rows, columns=columns)

    return batched.select("job_id", "batch", "seq", "id", "text").groupBy("job_id", "batch").applyInPandas(run, "job_id string, batch int, id string, text string, uncertain boolean, notes string, code string")


def _payloads(rows: DataFrame) -> DataFrame:
    items = F.struct(F.collect_list(F.struct("id", "text", "uncertain", "notes")).alias("translations"))
    return rows.groupBy("job_id").agg(F.to_json(items).alias("payload"))

