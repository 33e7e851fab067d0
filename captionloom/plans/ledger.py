"""The stage ledger: events and records as rows, resume decisions and the manifest as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each stage and the stage it depends on, in order.
DEPENDENCIES = {
    "normalize": "acquire",
    "prepare-eval": "normalize",
    "evaluate-asr": "prepare-eval",
    "transcribe": "evaluate-asr",
    "translate": "transcribe",
    "subtitles": "translate",
    "render": "subtitles",
    "validate": "render",
    "manifest": "validate",
}
EVALUATION_STAGES = ("prepare-eval", "evaluate-asr")
ALL_STAGES = tuple(DEPENDENCIES)
DEFAULT_STAGES = tuple(s for s in ALL_STAGES if s not in EVALUATION_STAGES)
#: Files besides the configuration that a stage's result depends on.
CONTEXT_FILES = {"evaluate-asr": ("asr/reference.json", "source/native.pt-BR.vtt", "source/native-caption-evidence.json"), "translate": ("asr/reference.json",)}
TRANSPORTS = ("local", "mp4", "hls", "dash")


def dependencies(single: bool) -> dict[str, str]:
    """In single mode nothing is evaluated, so transcribing depends on normalising."""
    return DEPENDENCIES | ({"transcribe": "normalize"} if single else {})


#: What a record may say of a stage.
STATUSES = ("running", "complete", "blocked")


def decode_states(lines: DataFrame, column: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a job-state log as records (schemas.STAGE_STATE and recorded_at) with `rule`, what is wrong with each, null if nothing.

    A line that is no JSON object of these types, without a job, of an unknown stage or status, without
    a time, blocked without a code, or whose outputs lack a path, a size or a hash, is not used; the
    rule tells no content. Null and empty lines are no objects; keys beyond these are ignored; columns to
    `carry` ride along.
    """
    from captionloom import schemas

    broken = "_broken"
    shape = f"{schemas.STAGE_STATE}, recorded_at string, {broken} string"
    text = F.coalesce(F.col(column), F.lit(""))
    read = lines.select(F.from_json(text, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("r"), *carry).select("r.*", *carry)
    object_ = F.col(broken).isNull() & F.coalesce("job_id", "stage", "status", "recorded_at").isNotNull()
    output = lambda o: o.isNotNull() & (F.length(o["path"]) > 0) & (o["bytes"] >= 0) & (F.length(o["sha256"]) > 0)
    rule = (
        F.when(~object_, "not a record")
        .when(F.coalesce(F.length(F.trim("job_id")), F.lit(0)) == 0, "no job")
        .when(~F.coalesce(F.col("stage").isin("acquire", *ALL_STAGES), F.lit(False)), "unknown stage")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status")
        .when(F.col("recorded_at").try_cast("timestamp").isNull(), "no time")
        .when((F.col("status") == "blocked") & (F.coalesce(F.length("code"), F.lit(0)) == 0), "no code")
        .when(~F.coalesce(F.forall("outputs", lambda o: F.coalesce(output(o), F.lit(False))), F.lit(True)), "output incomplete")
    )
    return read.withColumn("rule", rule).drop(broken)


def latest_state(records: DataFrame, by: str = "recorded_at") -> DataFrame:
    """The newest record of each (job_id, stage)."""
    rest = [c for c in records.columns if c not in ("job_id", "stage")]
    return records.groupBy("job_id", "stage").agg(F.max_by(F.struct(*rest), F.struct(by, *[c for c in rest if c != by and c != "outputs"])).alias("r")).select("job_id", "stage", "r.*")


def overall_status(latest: DataFrame) -> DataFrame:
    """(job_id, status) by the job's newest record: blocked, complete (manifest done) or in_progress."""
    last = latest.groupBy("job_id").agg(F.max_by(F.struct("stage", "status"), "recorded_at").alias("l"))
    status = F.when(F.col("l.status") == "blocked", "blocked").when((F.col("l.status") == "complete") & (F.col("l.stage") == "manifest"), "complete").otherwise("in_progress")
    return last.select("job_id", status.alias("status"))


def context_hash(stage: str, config_sha256: Column, files: dict[str, Column]) -> Column:
    """SHA-256 over the stage, the configuration and the stage's context files; absent ones are MISSING."""
    parts = [F.lit(stage), config_sha256, *[F.coalesce(files.get(p, F.lit(None).cast("string")), F.lit("MISSING")) for p in CONTEXT_FILES.get(stage, ())]]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def own_records_valid(latest: DataFrame, present: DataFrame, contexts: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(job_id, stage, completed_at, valid): complete, with outputs that all exist unchanged, under an equal context.

    `present` has (job_id, path, sha256) of existing files, `contexts` (job_id, stage, context_sha256). A
    record whose context is not among them is judged without it or, with `every`, refused, unless it
    is the source's.
    """
    outputs = latest.select("job_id", "stage", F.explode_outer("outputs").alias("o")).select("job_id", "stage", F.col("o.path").alias("path"), F.col("o.sha256").alias("wanted"))
    have = present.select("job_id", "path", F.col("sha256").alias("have"))
    same = outputs.join(have, ["job_id", "path"], "left").groupBy("job_id", "stage").agg(F.bool_and(F.coalesce(F.col("have") == F.col("wanted"), F.lit(False))).alias("_same"))
    out = latest.join(same, ["job_id", "stage"])
    ok = (F.col("status") == "complete") & F.col("_same")
    if contexts is not None:
        out = out.join(contexts.select("job_id", "stage", F.col("context_sha256").alias("_now")), ["job_id", "stage"], "left")
        unknown = (F.col("stage") == "acquire") if every else F.lit(True)
        ok &= F.when(F.col("_now").isNull(), unknown).otherwise(F.col("context_sha256").eqNullSafe(F.col("_now")))
    return out.select("job_id", "stage", "completed_at", ok.alias("valid"))


def resume_decisions(valid: DataFrame, single: bool = False) -> DataFrame:
    """(job_id, stage, resumable): valid itself and through its chain, nothing before it completed later.

    The chain has at most ten stages, so it is one pivoted row for each job and columns folded in
    order: no join for each step.
    """
    chain = dependencies(single)
    names = ["acquire", *ALL_STAGES]
    wide = valid.groupBy("job_id").pivot("stage", names).agg(F.first(F.struct("valid", "completed_at")))
    at = lambda s: F.col(f"`{s}`")
    fine: dict[str, Column] = {"acquire": F.coalesce(at("acquire")["valid"], F.lit(False))}
    for stage in ALL_STAGES:
        before = chain[stage]
        fine[stage] = F.coalesce(at(stage)["valid"] & fine[before] & (at(before)["completed_at"] <= at(stage)["completed_at"]), F.lit(False))
    return wide.select("job_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("resumable")) for s, c in fine.items()])).alias("d")).select("job_id", "d.stage", "d.resumable")


def receipt_codes(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, code) of source receipts (job_id, status, transport, source_path, bytes, sha256) against files."""
    f = files.select("job_id", F.col("path").alias("source_path"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"), "writable")
    both = receipts.join(f, ["job_id", "source_path"], "left")
    bad = (F.col("status") != "PASS") | ~F.col("transport").isin(*TRANSPORTS) | ~F.col("sha256").eqNullSafe(F.col("_sha")) | ~F.col("bytes").eqNullSafe(F.col("_bytes"))
    code = F.when(F.col("_sha").isNull(), "SOURCE_MISSING").when(F.coalesce(bad, F.lit(True)), "SOURCE_RECEIPT_INVALID").when(F.col("writable"), "SOURCE_NOT_IMMUTABLE")
    return both.select("job_id", code.alias("code"))


def manifest(required: DataFrame, present: DataFrame, reports: DataFrame) -> DataFrame:
    """(job_id, code, artifacts): the final ledger of each job.

    `required` has (job_id, path), `present` (job_id, path, bytes, sha256), `reports` (job_id, report,
    status). A report that is not PASS gives QUALITY_NOT_PASSING, an absent file
    COMPLETION_ARTIFACT_MISSING; else code is null and artifacts lists the files by path.
    """
    files = required.join(present, ["job_id", "path"], "left")
    listed = files.groupBy("job_id").agg(F.bool_and(F.col("sha256").isNotNull()).alias("_all"), F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("artifacts"))
    passed = reports.groupBy("job_id").agg(F.bool_and(F.coalesce(F.col("status") == "PASS", F.lit(False))).alias("_pass"))
    both = listed.join(passed, "job_id", "left")
    code = F.when(~F.coalesce("_pass", F.lit(False)), "QUALITY_NOT_PASSING").when(~F.col("_all"), "COMPLETION_ARTIFACT_MISSING")
    return both.select("job_id", code.alias("code"), F.when(code.isNull(), F.col("artifacts")).alias("artifacts"))


def output_checks(probes: DataFrame, source: DataFrame, max_drift: float = 0.35) -> DataFrame:
    """(job_id, output, rule) violations of rendered outputs.

    Both inputs have (job_id, duration, streams array<struct<codec_type, codec_name, language>>),
    `probes` also `output` (soft or burned). The soft one needs a video and an English subtitle stream
    and the source's codecs; both need video, the source's audio and its duration within max_drift.
    """
    s = source.select("job_id", F.col("duration").alias("_d"), F.col("streams").alias("_streams"))
    both = probes.join(s, "job_id")
    has = lambda c, kind: F.exists(c, lambda x: x["codec_type"] == kind)
    codec = lambda c, kind: F.get(F.filter(c, lambda x: x["codec_type"] == kind), F.lit(0))["codec_name"]
    soft = F.col("output") == "soft"
    found = [
        F.when(~has("streams", "video"), F.lit("video missing")),
        F.when(soft & ~has("streams", "subtitle"), F.lit("subtitle missing")),
        F.when(soft & ~F.exists("streams", lambda x: (x["codec_type"] == "subtitle") & x["language"].eqNullSafe(F.lit("eng"))), F.lit("subtitle language missing")),
        F.when(has("_streams", "audio") & ~has("streams", "audio"), F.lit("audio missing")),
        *[F.when(soft & ~codec("streams", k).eqNullSafe(codec("_streams", k)), F.lit(f"{k} codec changed")) for k in ("video", "audio")],
        F.when(F.abs(F.col("duration") - F.col("_d")) > max_drift, F.lit("duration drift")),
    ]
    return both.select("job_id", "output", F.explode(F.array_compact(F.array(*found))).alias("rule"))


def media_durations(probes: DataFrame, column: str = "probe") -> DataFrame:
    """(job_id, duration, width, height) from probe JSON: the container's duration, else the longest stream's."""
    from captionloom import schemas

    p = F.from_json(column, schemas.PROBE)
    streams = F.transform(p["streams"], lambda s: s["duration"].try_cast("double"))
    d = F.coalesce(p["format"]["duration"].try_cast("double"), F.array_max(streams))
    video = F.get(F.filter(p["streams"], lambda s: (s["codec_type"] == "video") & (s["width"] > 0) & (s["height"] > 0)), F.lit(0))
    good = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))
    return probes.select("job_id", F.when(good, d).alias("duration"), video["width"].alias("width"), video["height"].alias("height"))


def stage_order(latest: DataFrame) -> DataFrame:
    """Records with their place in the run, by completion."""
    return latest.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("completed_at", "stage")))
