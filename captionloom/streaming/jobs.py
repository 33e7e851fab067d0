"""Jobs' states as a stream: each event once, a row whenever what a job has come to changes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("job_id", "stage", "attempt", "status")
CHANGES = "job_id string, status string, stage string, code string, at timestamp, changes long"

#: What is held of a job between batches: its newest event and how often its state has changed.
HELD = "job_id string, stage string, status string, at timestamp, changes long"

#: The state of the stream is kept in this store, outside the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without replays: of those with equal job, stage, attempt and status only the first counts.

    A replay that comes later than `late` after its event is taken for a new one; what is known of an event
    is forgotten then, so that the state does not grow for ever.
    """
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(list(KEY))


def overall(stage: Column, status: Column) -> Column:
    """What a job has come to by its newest event, as ledger.overall_status() has it."""
    return F.when(status == "blocked", "blocked").when((status == "complete") & (stage == "manifest"), "complete").otherwise("in_progress")


def job_changes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(job_id, stage, status, code, at): the events that can change a job's state, each once; follow() tells which do."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    distinct = once(events.filter("job_id is not null and stage is not null and at is not null"), late)
    return distinct.filter("status is not null").select("job_id", "stage", "status", "code", "at")


def changes_of(events: DataFrame, held: DataFrame) -> DataFrame:
    """(CHANGES, event, changed, newest): rows of a batch's events that change their job's state or are its newest.

    Events of one batch are taken in order of their time; an event older than the newest held changes nothing.
    Of equal times the greater stage and status counts, so that the order of arrival does not matter. A
    job of which nothing came keeps what is held as its newest. All windows share one exchange and one sort.
    """
    rows = events.withColumns({"changes": F.lit(None).cast("long"), "held": F.lit(False)}).unionByName(held.withColumns({"code": F.lit(None).cast("string"), "held": F.lit(True)}))
    w = Window.partitionBy("job_id").orderBy(F.desc("held"), "at", "stage", "status", "code")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("at", "stage", "status")
    before = rows.withColumn("_before", F.first(F.when(F.col("held"), place)).over(so_far))
    counted = before.filter(F.col("held") | F.col("_before").isNull() | (place > F.col("_before"))).withColumn("state", overall(F.col("stage"), F.col("status")))
    told = counted.withColumns({"changed": ~F.col("held") & ~F.col("state").eqNullSafe(F.lag("state").over(w)), "newest": F.lead("job_id").over(w).isNull()})
    told = told.withColumn("changes", F.sum(F.when(F.col("held"), F.col("changes")).otherwise(F.col("changed").cast("long"))).over(so_far))
    return told.filter("changed or newest").select("job_id", F.col("state").alias("status"), "stage", "code", "at", "changes", F.col("status").alias("event"), "changed", "newest")


def follow(events: DataFrame, folder: str) -> DataFrame:
    """Run what job_changes() gives to the end of its input: the last row of each job's changes (CHANGES).

    A row for each change of a job's state is written to `folder`/changes, batches under their number, so that one
    written again replaces itself. What is held of jobs goes from batch to batch by two folders in turn: a batch
    that is run again finds what was held before it. The checkpoint is there too, and a later call goes on
    from it. Without input there are no rows.
    """
    spark: SparkSession = events.sparkSession

    def sink(batch: DataFrame, k: int) -> None:
        s = batch.sparkSession
        held = s.read.schema(HELD).parquet(f"{folder}/held/{(k - 1) % 2}") if k else s.createDataFrame([], HELD)
        told = changes_of(batch, held).persist()  # the stream's own state is not gone through twice
        try:
            told.filter("changed").select("job_id", "status", "stage", "code", "at", "changes").write.mode("overwrite").parquet(f"{folder}/changes/batch={k}")
            told.filter("newest").select("job_id", "stage", F.col("event").alias("status"), "at", "changes").write.mode("overwrite").parquet(f"{folder}/held/{k % 2}")
        finally:
            told.unpersist()

    query = events.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        rows = spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CHANGES)
    last = F.max_by(F.struct("status", "stage", "code", "at", "changes"), "changes")
    return rows.groupBy("job_id").agg(last.alias("l")).select("job_id", "l.*")
