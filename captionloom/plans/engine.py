"""Running stages for many jobs: plan, dispatch and record."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from captionloom import schemas
from captionloom.plans import ledger

#: A stage: (session, the jobs to do as (job_id)) -> what it made as (job_id, path, bytes, sha256) and, if it
#: can fail for single jobs, `code`: a job with a code on any row is blocked under it, the others go on.
Stage = Callable[[SparkSession, DataFrame], DataFrame]

#: An event of a job; events of equal job, stage, attempt and status are the same.
EVENT = "job_id string, stage string, status string, code string, attempt string, at timestamp"

#: What is on the jobs' disks now: session -> (job_id, path, sha256), paths as in the stages' outputs.
Present = Callable[[SparkSession], DataFrame]


class StageBlocked(RuntimeError):
    """A stage that cannot go on, with a stable code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


class ProviderError(RuntimeError):
    pass


class ProviderUnavailable(ProviderError):
    pass


class MediaError(RuntimeError):
    pass


#: Which code an exception is recorded under; anything else is INTERNAL_FAILURE.
#: What a job is blocked under for which a stage gives no row at all.
NO_RESULT = "STAGE_WITHOUT_RESULT"
CODES = ((ProviderUnavailable, "PROVIDER_UNAVAILABLE"), (ProviderError, "PROVIDER_FAILURE"), (MediaError, "MEDIA_FAILURE"))


def plan(single: bool, stages: list[str] | None = None) -> list[str]:
    """The stages to run, in the order given; unknown names are refused."""
    names = list(stages) if stages is not None else list(ledger.DEFAULT_STAGES if single else ledger.ALL_STAGES)
    if any(s not in ledger.ALL_STAGES for s in names):
        raise StageBlocked("UNKNOWN_STAGE")
    return names


class Engine:
    """Runs stages for many jobs at once and records each job's state in a table, the ledger.

    `jobs` (job_id) are all there are; without it, those of the ledger. A stage is recorded as running,
    then as complete with its outputs and the context that it ran under, or as blocked with a code. With
    `resume`, a stage does the jobs alone whose records the ledger finds no longer valid: whose outputs
    changed or are gone, whose configuration or context files changed, or before which a stage ran anew.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: dict[str, Stage], single: bool = True, jobs: DataFrame | None = None, present: Present | None = None, config_sha256: str = ""):
        self.spark, self.folder, self.stages, self.single = spark, folder.rstrip("/"), stages, single
        self.given, self.present, self.config_sha256 = jobs, present, config_sha256

    def records(self) -> DataFrame:
        """The records that can be used; what invalid() has is left out."""
        return self._states().filter("rule is null").drop("rule")

    def invalid(self) -> DataFrame:
        """(rule, n): how many lines of the ledger are no records, and why."""
        return self._states().filter("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))

    def _states(self) -> DataFrame:
        try:
            lines = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.folder}/records")
        except AnalysisException as e:  # the folder appears with the first record
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lines = self.spark.createDataFrame([], "value string")
        return ledger.decode_states(lines)

    def events(self) -> DataFrame:
        """The event log as it is; streaming.events reads it as a stream. An event may stand there twice."""
        try:
            return self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").json(f"{self.folder}/events")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT)

    def jobs(self) -> DataFrame:
        return (self.records() if self.given is None else self.given).select("job_id").distinct()

    def files(self) -> DataFrame:
        return self.spark.createDataFrame([], "job_id string, path string, sha256 string") if self.present is None else self.present(self.spark)

    def contexts(self, jobs: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """(job_id, stage, context_sha256) of all stages, after the files that are there now."""
        wanted = sorted({p for files in ledger.CONTEXT_FILES.values() for p in files})
        have = (self.files() if files is None else files).filter(F.col("path").isin(wanted)).groupBy("job_id").agg(F.map_from_entries(F.collect_set(F.struct("path", "sha256"))).alias("_have"))
        both = jobs.join(have, "job_id", "left")
        now = {p: F.try_element_at("_have", F.lit(p)) for p in wanted}
        made = [F.struct(F.lit(s).alias("stage"), ledger.context_hash(s, F.lit(self.config_sha256), now).alias("context_sha256")) for s in ("acquire", *ledger.ALL_STAGES)]
        return both.select("job_id", F.explode(F.array(*made)).alias("c")).select("job_id", "c.*")

    def resumable(self) -> DataFrame:
        """(job_id, stage, resumable) for the ledger's jobs."""
        latest = ledger.latest_state(self.records())
        files = self._fixed(self.files(), "files")
        # The source is what it is, whatever the configuration.
        contexts = self.contexts(latest.select("job_id").distinct(), files).filter("stage != 'acquire'")
        return ledger.resume_decisions(ledger.own_records_valid(latest, files, contexts, every=True), self.single)

    def acquired(self, outputs: DataFrame) -> None:
        """Record the jobs' sources (job_id, path, bytes, sha256), which every chain of stages starts from."""
        self._complete("acquire", outputs, outputs.select("job_id").distinct(), _now())

    def _record(self, rows: DataFrame, stage: str, status: str, **given: Column | str | None) -> None:
        """Append a row for each job; what is not given is null."""
        none = F.lit(None)
        columns = {"stage": F.lit(stage), "status": F.lit(status), "recorded_at": F.lit(_now())} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()}
        schema = StructType.fromDDL(f"{schemas.STAGE_STATE}, recorded_at string")
        rows.select(*[F.col("job_id") if f.name == "job_id" else columns.get(f.name, none).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").json(f"{self.folder}/records")

    def _complete(self, stage: str, made: DataFrame, jobs: DataFrame, started: str) -> None:
        outputs = made.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("_outputs"))
        rows = outputs.join(self.contexts(jobs).filter(F.col("stage") == stage).select("job_id", "context_sha256"), "job_id", "left")
        self._record(rows, stage, "complete", started_at=started, completed_at=_now(), context_sha256=F.col("context_sha256"), outputs=F.col("_outputs"))

    def _event(self, jobs: DataFrame, stage: str, status: str, attempt: str) -> None:
        """An event for each of jobs (job_id and, if blocked, code).

        Events of an attempt of a stage are one folder, written anew when it is written again; a reader that
        saw both tells them by their key (job_id, stage, attempt, status).
        """
        code = F.col("code") if "code" in jobs.columns else F.lit(None).cast("string")
        rows = jobs.select("job_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), code.alias("code"), F.lit(attempt).alias("attempt"), F.lit(_now()).alias("at"))
        rows.write.mode("overwrite").json(f"{self.folder}/events/{stage}-{re.sub('[^0-9A-Za-z]', '-', attempt)}-{status}")

    def run(self, stages: list[str] | None = None, dry_run: bool = False, resume: bool = False) -> list[str]:
        """The stages that ran for any job.

        Jobs that a stage blocks take no part in the stages after it. When a stage leaves no job at all,
        StageBlocked is raised, under the code if all have one.
        """
        names = plan(self.single, stages)
        if dry_run:
            return names
        ran, open_ = [], self.jobs()
        for name in names:
            jobs = open_
            if resume:
                jobs = jobs.join(self.resumable().filter((F.col("stage") == name) & F.col("resumable")), "job_id", "left_anti")
            # What is to be done is fixed before the records change.
            todo = self._fixed(jobs, f"todo/{name}")
            if todo.isEmpty():
                continue
            blocked = self._attempt(name, todo)
            ran.append(name)
            codes = [r["code"] for r in blocked.select("code").distinct().limit(2).collect()]
            if codes:
                open_ = self._fixed(open_.join(blocked, "job_id", "left_anti"), f"open/{name}")
                if open_.isEmpty():
                    raise StageBlocked(codes[0] if len(codes) == 1 else "ALL_JOBS_BLOCKED")
        return ran

    def _attempt(self, name: str, todo: DataFrame) -> DataFrame:
        """Run a stage for the jobs and record what became of each: (job_id, code) of those it blocks."""
        started = _now()
        self._record(todo, name, "running", started_at=started)
        self._event(todo, name, "running", started)
        failure = None
        try:
            result = self.stages[name](self.spark, todo)
            if "code" not in result.columns:
                result = result.withColumn("code", F.lit(None).cast("string"))
            made = self._fixed(result.select("job_id", "path", F.col("bytes").cast("bigint").alias("bytes"), "sha256", "code"), f"made/{name}")
            coded = made.groupBy("job_id").agg(F.min("code").alias("code"))
            blocked = todo.join(coded.withColumn("_there", F.lit(True)), "job_id", "left").select("job_id", F.when(F.col("_there").isNull(), NO_RESULT).otherwise(F.col("code")).alias("code")).filter("code is not null")
        except Exception as e:
            failure = e
            code = e.code if isinstance(e, StageBlocked) else next((c for kind, c in CODES if isinstance(e, kind)), "INTERNAL_FAILURE")
            blocked = todo.select("job_id", F.lit(code).alias("code"))
        blocked = self._fixed(blocked, f"blocked/{name}")
        if failure is None:
            done = todo.join(blocked, "job_id", "left_anti")
            self._complete(name, made.filter("path is not null").join(done, "job_id", "left_semi"), done, started)
            self._event(done, name, "complete", started)
        self._record(blocked, name, "blocked", started_at=started, failed_at=_now(), code=F.col("code"))
        self._event(blocked, name, "blocked", started)
        if failure is not None:
            raise StageBlocked(code) from failure
        return blocked

    def _fixed(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, written to the ledger's folder and read back; what was there before under the name is gone then."""
        path = f"{self.folder}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def status(self) -> DataFrame:
        return ledger.overall_status(ledger.latest_state(self.records()))


def _now() -> str:
    return datetime.now(UTC).isoformat()
