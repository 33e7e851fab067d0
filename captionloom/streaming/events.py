"""The append-only event log as a stream: JSON lines in, the state of stages out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.plans.engine import EVENT
from captionloom.session import shared_folder

EVENTS = EVENT


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of the log as they appear, an Engine's too; lines that are no events give nulls and are dropped."""
    lines = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").json(folder)
    return lines.filter("job_id is not null and stage is not null")


def stage_states(events: DataFrame) -> DataFrame:
    """The latest status of each (job_id, stage); on a stream, use output mode `update` or `complete`."""
    last = F.max_by(F.struct("status", "code"), F.struct("at", "status"))
    return events.groupBy("job_id", "stage").agg(last.alias("l"), F.max("at").alias("at"), F.count("*").alias("events")).select("job_id", "stage", "l.status", "l.code", "at", "events")


def blocked_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, stage, events, blocked) in tumbling windows; events later than `late` are dropped."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", window), "stage").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    return counted.select(F.col("window.start").alias("start"), "stage", "events", "blocked")


def run_to_end(result: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run a streaming aggregate over all input there is and return its last result; without input, no rows.

    Batches go through foreachBatch to `folder`, where the checkpoint is too: called again with the same
    folder, the query goes on where it stopped, and rewrites at most its last batch. Without a folder
    it starts anew in one of its own in the shared folder.
    """
    spark = result.sparkSession
    folder = folder or f"{shared_folder(spark)}/captionloom-stream-{uuid.uuid4().hex}"
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/result")
    query = result.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.schema(result.schema).parquet(f"{folder}/result")
    except AnalysisException as e:  # no batch has run, as there was no input
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], result.schema)
