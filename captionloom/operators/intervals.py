"""Interval operators on rows (keys..., start, end): union, overlap, ratio, semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionloom.functions.text import finite


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint intervals covering those of each key; touching ones merge; empty and non-finite ones are ignored."""
    kind = rows.schema[start].dataType.simpleString()
    good = F.col(end) > F.col(start)
    if kind == "double":
        good &= finite(F.col(start)) & finite(F.col(end))
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.filter(good).withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap_lengths(a: DataFrame, b: DataFrame, keys: list[str], width: float, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, overlap): common length of two sets of disjoint intervals.

    Both sides are cut into bins of `width`, so the join is an equi-join on keys and bin however many
    intervals a key has; a pair counts in the bin where its overlap starts.
    """
    binned = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_bin")
    left = a.select(*keys, start, end, binned)
    right = b.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), binned)
    low, high = F.greatest(F.col(start), F.col("_s")), F.least(F.col(end), F.col("_e"))
    met = left.join(right, [*keys, "_bin"]).filter((low < high) & (F.floor(low / width) == F.col("_bin")))
    return met.groupBy(*keys).agg(F.sum(high - low).alias("overlap"))


def timing_iou(reference: DataFrame, candidate: DataFrame, job: str = "job_id", track: str = "candidate", start: str = "start_ms", end: str = "end_ms", width: float = 60_000) -> DataFrame:
    """(job, track, timing_iou): overlap over union of speech; 1 if neither side speaks, 0 if one does not.

    `candidate` names its tracks; each is compared with the job's reference. Tracks come from
    candidate's rows, jobs without a reference row have a silent one.
    """
    tracks = candidate.select(job, track).distinct()
    a = merge_intervals(reference, [job], start, end)
    b = merge_intervals(candidate, [job, track], start, end)
    length = F.sum(F.col(end) - F.col(start))
    total_a = a.groupBy(job).agg(length.alias("_a"))
    total_b = b.groupBy(job, track).agg(length.alias("_b"))
    common = overlap_lengths(b, tracks.join(a, job), [job, track], width, start, end)
    joined = tracks.join(total_a, job, "left").join(total_b, [job, track], "left").join(common, [job, track], "left")
    x, y, o = (F.coalesce(F.col(c), F.lit(0)) for c in ("_a", "_b", "overlap"))
    ratio = F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(o / F.nullif(x + y - o, F.lit(0)))
    return joined.select(job, track, ratio.cast("double").alias("timing_iou"))


def overlapping(rows: DataFrame, windows: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Rows that overlap any window (key, from, to) of their key; touching is no overlap.

    A row overlaps one if the latest end among the windows that begin before the row ends lies behind
    the row's start. So rows and windows are sorted together once, and no pair is made.
    """
    named = F.struct(*[F.col(c) for c in rows.columns])
    kind = rows.schema[end].dataType
    mine = rows.select(F.col(key).alias("_key"), F.col(end).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_to"), named.alias("_row"))
    given = windows.select(F.col(key).alias("_key"), F.col("from").cast(kind).alias("_at"), F.lit(1).alias("_kind"), F.col("to").cast(kind).alias("_to"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = mine.union(given).withColumn("_latest", F.max("_to").over(order))
    return latest.filter((F.col("_kind") == 0) & (F.col("_latest") > F.col("_row")[start])).select("_row.*")


def with_gaps(cues: DataFrame, key: str, total: DataFrame) -> DataFrame:
    """The timeline of a job as (key, start_ms, end_ms, index or null): cues and the gaps around them.

    `total` has (key, total_ms). Cues count from where the last one ended if they overlap it.
    """
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms", "index")
    ended = F.coalesce(F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cues.select(key, "index", F.greatest("start_ms", ended).alias("start_ms"), "end_ms", ended.alias("_ended")).filter("end_ms > start_ms")
    gaps = placed.filter("start_ms > _ended").select(key, F.col("_ended").alias("start_ms"), F.col("start_ms").alias("end_ms"), F.lit(None).cast("long").alias("index"))
    last = total.join(placed.groupBy(key).agg(F.max("end_ms").alias("_last")), key, "left")
    tail = last.select(key, F.coalesce("_last", F.lit(0)).alias("start_ms"), F.col("total_ms").alias("end_ms"), F.lit(None).cast("long").alias("index")).filter("end_ms > start_ms")
    return placed.select(key, "start_ms", "end_ms", F.col("index").cast("long").alias("index")).union(gaps).union(tail)
