"""Timed-text views over the sample tables, which hold no transcripts of their own.

A conversation is a job, a turn a segment; times are whole milliseconds derived from text lengths, so
sums are exact. Rows without conv_id or turn belong to no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Terms that every job's transcript is asked for.
TERMS = ("the", "of", "no such term", "and the")
NUMBERS = ("42", "7")
PAUSE_MS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("string").alias("job_id"), F.col("turn").cast("int").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("id"), "role", text.alias("text"),
        F.greatest(F.lit(1000), F.length(text) * 50).cast("bigint").alias("_dur"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100 / 100).alias("confidence"), (F.col("conv_id") * 7 + F.col("turn")).alias("k"),
    )
    before = F.sum(F.col("_dur") + PAUSE_MS).over(Window.partitionBy("job_id").orderBy("seq")) - F.col("_dur") - PAUSE_MS
    flags = F.when(F.col("confidence") < 0.2, F.array(F.lit("low_segment_confidence"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("start_ms", before).withColumn("end_ms", F.col("start_ms") + F.col("_dur")).withColumn("uncertainty", flags).drop("_dur")


def in_seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start_ms") / 1000).withColumn("end", F.col("end_ms") / 1000)


def candidates(segs: DataFrame) -> DataFrame:
    """Two damaged tracks: `drop7` lacks every seventh word and is 300 ms late, `sub5` says x for every fifth, 700 ms late."""
    words = F.split("text", " ")
    track = lambda name, made, late: segs.select("job_id", F.lit(name).alias("candidate"), "seq", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), F.array_join(made, " ").alias("text"))
    dropped = F.filter(words, lambda w, i: i % 7 != 3)
    swapped = F.transform(words, lambda w, i: F.when(i % 5 == 2, F.lit("x")).otherwise(w))
    return track("drop7", dropped, 300).union(track("sub5", swapped, 700))


def tracks(segs: DataFrame) -> DataFrame:
    """candidates() and two good tracks that tie, 100 ms late: every eleventh turn ends in another word."""
    words = F.split("text", " ")
    ended = F.when(F.col("k") % 11 == 0, F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.lit("x")))).otherwise(words)
    good = segs.select("job_id", F.explode(F.array(F.lit("native"), F.lit("twin"))).alias("candidate"), "seq", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") + 100).alias("end_ms"), F.array_join(ended, " ").alias("text"))
    return candidates(segs).union(good)


def durations(segs: DataFrame) -> DataFrame:
    return segs.groupBy("job_id").agg((F.max("end_ms") / 1000).alias("duration"))


def per_job(segs: DataFrame, values: tuple[str, ...], name: str) -> DataFrame:
    return segs.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def translations(segs: DataFrame) -> DataFrame:
    """Copies of the segments with missing rows, moved times, an added number and dropped flags, by k."""
    k = F.col("k")
    made = in_seconds(segs).filter(k % 23 != 0)
    late = F.when(k % 19 == 1, 5).otherwise(0) / 1000
    return made.select(
        "job_id", "seq", "id", (F.col("start") + late).alias("start"), "end", F.col("text").alias("source_text"), F.when(k % 17 == 2, F.concat("text", F.lit(" 42"))).otherwise(F.col("text")).alias("text"),
        F.when(k % 13 == 3, F.array().cast("array<string>")).otherwise(F.col("uncertainty")).alias("uncertainty"), F.lit("").alias("notes"),
    )


#: The same views as DuckDB SQL.
SQL_SEGMENTS = f"""
turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, greatest(1000, length(coalesce(text, '')) * 50)::BIGINT AS dur FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
seg AS (SELECT conv_id::VARCHAR AS job_id, turn::INTEGER AS seq, conv_id::VARCHAR || '-' || turn::VARCHAR AS id, role, text, ((conv_id * 31 + turn * 17) % 100) / 100.0::DOUBLE AS confidence, conv_id * 7 + turn AS k,
  (sum(dur + {PAUSE_MS}) OVER (PARTITION BY conv_id ORDER BY turn) - dur - {PAUSE_MS})::BIGINT AS start_ms, (sum(dur + {PAUSE_MS}) OVER (PARTITION BY conv_id ORDER BY turn) - {PAUSE_MS})::BIGINT AS end_ms FROM turns)"""
SQL_CANDIDATES = """
words AS (SELECT job_id, seq, start_ms, end_ms, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM seg),
cand AS (
  SELECT s.job_id, 'drop7' AS candidate, s.seq, s.start_ms + 300 AS start_ms, s.end_ms + 300 AS end_ms, coalesce(d.text, '') AS text FROM seg s LEFT JOIN (SELECT job_id, seq, string_agg(w, ' ' ORDER BY i) AS text FROM words WHERE i % 7 <> 3 GROUP BY ALL) d USING (job_id, seq)
  UNION ALL
  SELECT s.job_id, 'sub5', s.seq, s.start_ms + 700, s.end_ms + 700, coalesce(d.text, '') FROM seg s LEFT JOIN (SELECT job_id, seq, string_agg(CASE WHEN i % 5 = 2 THEN 'x' ELSE w END, ' ' ORDER BY i) AS text FROM words GROUP BY ALL) d USING (job_id, seq))"""
SQL_TRACKS = SQL_CANDIDATES.replace("cand AS (", "two AS (") + """,
cand AS (SELECT * FROM two UNION ALL SELECT job_id, c.candidate, seq, start_ms + 100, end_ms + 100, CASE WHEN k % 11 = 0 THEN array_to_string(string_split(text, ' ')[:-2] || ['x'], ' ') ELSE text END FROM seg CROSS JOIN (SELECT unnest(['native', 'twin']) AS candidate) c)"""
SQL_TRANSLATIONS = """
src AS (SELECT *, start_ms / 1000.0::DOUBLE AS "start", end_ms / 1000.0::DOUBLE AS "end", confidence < 0.2 AS flagged FROM seg),
tr AS (SELECT job_id, seq, id, k, "start" + (CASE WHEN k % 19 = 1 THEN 5 ELSE 0 END) / 1000.0::DOUBLE AS "start", "end", CASE WHEN k % 17 = 2 THEN text || ' 42' ELSE text END AS text, CASE WHEN k % 13 = 3 THEN false ELSE flagged END AS flagged FROM src WHERE k % 23 <> 0)"""
