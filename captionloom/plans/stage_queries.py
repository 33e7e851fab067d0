"""Queries that run whole stages, events and evidence over jobs of the sample tables, some of them damaged.

A conversation is a job whose audio says its turns. Its number modulo 20 tells what is wrong with it; texts
without a word and cues against the policy are found in the data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.operators import evidence, metrics
from captionloom.plans import ledger, stages, views
from captionloom.plans.engine import Engine, ProviderError
from captionloom.plans.queries import SQL_CUES, SQL_LAYOUT, SQL_SRT, SQL_VTT, TOKENS, _plain_cues, query
from captionloom.session import shared_folder
from captionloom.sources import captions, publish
from captionloom.streaming import jobs as job_stream

STAGES = ("normalize", "transcribe", "translate", "subtitles", "render", "validate", "manifest")

#: Letters for digits, as a number's reading depends on the language; twice the time, so that texts can be read.
DIGITS, LETTERS = "0123456789", "abcdefghij"


def recogniser(path: str | None, *, language: str, min_confidence: float) -> str | None:
    """What a chunk's audio says; the sample's audio is written in its location."""
    return path


def translator(segments: list[dict], *, source_language: str, target_language: str, terms: list[str]) -> list[dict]:
    """The text itself; marks at its start make the service fail, leave a segment out or count wrong."""
    if any(s["text"].startswith("[unavailable]") for s in segments):
        raise ProviderError("no answer")
    kept = [s for s in segments if not s["text"].startswith("[drop]")]
    return [{"id": s["id"], "text": s["text"] + (" 42" if s["text"].startswith("[count]") else "")} for s in kept]


def _sample(spark, sf_dir) -> tuple[DataFrame, stages.JobStages, DataFrame]:
    """(jobs, work, receipts) of the sample's conversations."""
    segs = views.segments(spark, sf_dir)
    number = F.col("job_id").cast("long")
    kind = number % 20
    jobs = segs.select("job_id").distinct()
    mark = F.when(F.col("seq") == F.min("seq").over(views.Window.partitionBy("job_id")), F.when(kind == 8, "[unavailable] ").when(kind == 9, "[drop] ").when(kind == 10, "[count] ")).otherwise(F.lit(None))
    said = segs.select("job_id", "seq", (F.col("start_ms") / 500).alias("start"), (F.col("end_ms") / 500).alias("end"), F.concat(F.coalesce(mark, F.lit("")), F.translate("text", DIGITS, LETTERS)).alias("text"))
    durations = said.groupBy("job_id").agg(F.max("end").alias("duration"))
    late = F.when((kind == 7) & (F.col("seq") == F.max("seq").over(views.Window.partitionBy("job_id"))), 100.0).otherwise(0.0)
    part = F.floor(F.col("start") / 600).cast("int")
    moved = said.select("job_id", "seq", part.alias("part"), (F.col("start") - part * 600).alias("start"), (F.col("end") - part * 600 + late).alias("end"), "text").filter(kind != 6)
    heard = moved.groupBy("job_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("s"))
    payload = F.to_json(F.struct(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(-0.01).alias("avg_logprob"))).alias("segments")))
    chunks = durations.select("job_id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / 600), F.lit(1)).cast("int") - 1)).alias("part"))
    audio = chunks.join(heard.select("job_id", "part", payload.alias("payload")), ["job_id", "part"], "left").select("job_id", "part", F.when(kind == 5, "no json").otherwise(F.coalesce("payload", F.lit('{"segments": []}'))).alias("path"))

    digest = F.sha2(F.concat(F.lit("source of "), "job_id"), 256)
    media = jobs.filter(kind != 2).select("job_id", F.lit("source/source.mp4").alias("path"), F.lit(1000).cast("bigint").alias("bytes"), digest.alias("sha256"), (kind == 3).alias("writable"))
    receipt = F.to_json(F.struct(F.lit("PASS").alias("status"), F.lit("local").alias("transport"), F.lit("source/source.mp4").alias("source_path"), F.lit(1000).alias("bytes"), F.when(kind == 1, "another").otherwise(digest).alias("sha256")))
    receipts = jobs.select("job_id", F.lit(stages.RECEIPT).alias("path"), receipt.alias("content"))
    stream = lambda of, codec, language=None: F.struct(F.lit(of).alias("codec_type"), F.lit(codec).alias("codec_name"), F.lit(language).cast("string").alias("language"))
    picture = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(320).alias("width"), F.lit(180).alias("height"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    probe = F.to_json(F.struct(F.struct(F.col("duration").cast("string").alias("duration")).alias("format"), F.array(picture, sound).alias("streams")))
    probes = durations.select("job_id", F.when(kind == 4, "{}").otherwise(probe).alias("probe"))
    soft = F.array(stream("video", "h264"), stream("audio", "aac"), F.when(kind == 13, stream("subtitle", "mov_text", "por")).otherwise(stream("subtitle", "mov_text", "eng")))
    output = lambda path, streams: durations.select("job_id", F.lit(path).alias("path"), F.lit(2000).cast("bigint").alias("bytes"), F.sha2(F.concat(F.lit(path), "job_id"), 256).alias("sha256"), "duration", streams.alias("streams"))
    rendered = output(stages.SOFT, soft).union(output(stages.BURNED, F.array(stream("video", "h264"), stream("audio", "aac"))).filter(kind != 12))
    dark, lit = bytes(48), bytes(12) + b"\xff" * 36
    place = jobs.select("job_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    frame = lambda side, pixels: place.select("job_id", F.lit(side).alias("side"), "ordinal", F.concat(F.lit(f"validation/{side}/"), "ordinal", F.lit(".rgb")).alias("path"), pixels.alias("pixels"))
    burned = frame("burned", F.when(kind == 14, F.lit(dark)).otherwise(F.lit(lit))).filter(~((kind == 15) & (F.col("ordinal") == 1)))
    frames = frame("source", F.lit(dark)).union(burned).select("job_id", "side", "ordinal", "path", F.sha2("pixels", 256).alias("sha256"), F.lit(4).alias("width"), F.lit(4).alias("height"), "pixels")
    return jobs, stages.JobStages(media, probes, rendered, frames, recogniser, translator, audio), receipts


def _damage(jobs: DataFrame) -> DataFrame:
    """What goes wrong between validation and the manifest: a file gone, a list too short, a report that no longer passes."""
    kind = F.col("job_id").cast("long") % 20
    ragged = json.dumps({"quality_status": "PASS", "sampled_frames": [], "source_sampled_frames": [], "burned_lower_frame_difference_ratio": [0.5]})
    path = F.when(kind == 16, stages.VTT).when(kind == 17, stages.REPORT).when(kind == 18, stages.TRANSCRIPT_REPORT)
    content = F.when(kind == 17, ragged).when(kind == 18, '{"status": "BLOCKED"}')
    return jobs.filter(kind.isin(16, 17, 18)).select("job_id", path.alias("path"), content.alias("content"))


def run_stages(spark, sf_dir) -> Engine:
    """An engine that has run all stages for all jobs of the sample."""
    jobs, work, receipts = _sample(spark, sf_dir)
    folder = f"{shared_folder(spark)}/captionloom-stages-{uuid.uuid4().hex}"
    kept = stages.Artifacts(spark, f"{folder}/artifacts")
    kept.add(receipts, 0)
    engine = Engine(spark, f"{folder}/ledger", work.stages(kept), True, jobs, kept.present)
    engine.acquired(work.media.select("job_id", "path", "bytes", "sha256"))
    engine.run(list(STAGES[:-1]))
    kept.add(_damage(jobs), 90)
    good = engine.status().filter("status = 'in_progress'").select("job_id")
    last = Engine(spark, f"{folder}/ledger", work.stages(kept, 100), True, good, kept.present)
    last.run([STAGES[-1]])
    return last


#: The stage that blocks a job is the first that finds a fault; cues are laid out and judged as for the other queries.
SQL_OUTCOMES = f"""
turns AS (SELECT conv_id, turn, translate(coalesce(text, ''), '{DIGITS}', '{LETTERS}') AS text, 2 * greatest(1000, length(coalesce(text, '')) * 50)::BIGINT AS dur FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
seg AS (SELECT conv_id::VARCHAR AS job_id, conv_id % 20 AS kind, turn::INTEGER AS seq, conv_id::VARCHAR || '-' || turn::VARCHAR AS id, text,
  (sum(dur + {2 * views.PAUSE_MS}) OVER (PARTITION BY conv_id ORDER BY turn) - dur - {2 * views.PAUSE_MS})::BIGINT AS start_ms, (sum(dur + {2 * views.PAUSE_MS}) OVER (PARTITION BY conv_id ORDER BY turn) - {2 * views.PAUSE_MS})::BIGINT AS end_ms FROM turns),
heard AS (SELECT job_id, kind, bool_or(trim(text) = '') AS blank FROM seg GROUP BY ALL),
tr AS (SELECT s.job_id, seq, id, start_ms / 1000.0::DOUBLE AS "start", end_ms / 1000.0::DOUBLE AS "end", trim(text) AS text FROM seg s JOIN heard h USING (job_id) WHERE NOT h.blank AND s.kind NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
{SQL_LAYOUT},
judged AS (SELECT l.job_id, length(replace(text, chr(10), '')) / (closes - opens) > 20.01 OR closes - opens > 7.001 OR closes - opens < 0.999 OR opens < lag(closes) OVER w + 0.08 - 0.001 OR closes > d.duration + 0.001
  OR len(string_split(text, chr(10))) > 2 OR list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 42 AS bad FROM laid l JOIN dur d USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY index)),
cue_faults AS (SELECT job_id, bool_or(bad) AS bad FROM judged GROUP BY job_id),
said AS (SELECT job_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '\\s+', ' ', 'g')) AS a FROM tr GROUP BY job_id),
seen AS (SELECT job_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY index), '\\s+', ' ', 'g')) AS b FROM laid GROUP BY job_id),
fault AS (SELECT h.job_id, CASE WHEN kind IN (1, 2, 3, 4) THEN 1 WHEN kind IN (5, 6, 7) OR blank THEN 2 WHEN kind IN (8, 9, 10) THEN 3 WHEN coalesce(bad, false) OR coalesce(a, '') <> coalesce(b, '') THEN 4 WHEN kind = 12 THEN 5 WHEN kind IN (13, 14, 15) THEN 6 WHEN kind IN (16, 17, 18) THEN 7 ELSE 8 END AS stop,
  CASE WHEN kind = 1 THEN 'SOURCE_RECEIPT_INVALID' WHEN kind = 2 THEN 'SOURCE_MISSING' WHEN kind = 3 THEN 'SOURCE_NOT_IMMUTABLE' WHEN kind = 4 THEN 'MEDIA_FAILURE' WHEN kind = 5 THEN 'PROVIDER_FAILURE' WHEN kind = 6 THEN 'TRANSCRIPT_EMPTY' WHEN kind = 7 OR blank THEN 'TRANSCRIPT_VALIDATION_FAILED'
    WHEN kind IN (8, 9) THEN 'PROVIDER_FAILURE' WHEN kind = 10 THEN 'TRANSLATION_VALIDATION_FAILED' WHEN coalesce(bad, false) OR coalesce(a, '') <> coalesce(b, '') THEN 'SUBTITLE_POLICY_FAILED' WHEN kind = 12 THEN 'MEDIA_FAILURE' WHEN kind IN (13, 14, 15) THEN 'OUTPUT_VALIDATION_FAILED'
    WHEN kind = 16 THEN 'COMPLETION_ARTIFACT_MISSING' WHEN kind = 17 THEN 'VALIDATION_EVIDENCE_INVALID' WHEN kind = 18 THEN 'QUALITY_NOT_PASSING' END AS code
  FROM heard h LEFT JOIN cue_faults USING (job_id) LEFT JOIN said USING (job_id) LEFT JOIN seen USING (job_id)),
ord AS (SELECT unnest([{', '.join(repr(s) for s in STAGES)}]) AS stage, unnest(range(1, 8)) AS k),
ran AS (SELECT job_id, stage, k, CASE WHEN k = stop THEN 'blocked' ELSE 'complete' END AS status, CASE WHEN k = stop THEN code END AS code FROM fault JOIN ord ON k <= stop)"""


@query(f"WITH RECURSIVE {SQL_OUTCOMES} SELECT job_id, stage, status, code FROM ran")
def stage_outcomes(spark, sf_dir):
    """Every stage of every job, one job's failure kept apart from the others'."""
    return ledger.latest_state(run_stages(spark, sf_dir).records()).filter("stage != 'acquire'").select("job_id", "stage", "status", "code")


#: Pictures of 6 x 5 points; a channel's value follows from the event, the place and, in the burned picture, the overlay.
WIDTH, HEIGHT = 6, 5
PICTURE = WIDTH * HEIGHT * 3
PLAIN = b"".join(bytes((e * 7 + i * 13) % 200 for i in range(PICTURE)) for e in range(200))
OVERLAID = b"".join(bytes((e * 7 + i * 13) % 200 + (20 + e % 10 if i % 9 < e % 6 else 0) for i in range(PICTURE)) for e in range(600))
SQL_FRAMES = """
f AS (SELECT event_id AS e, (event_id // 8)::VARCHAR AS job_id, (event_id % 8)::INTEGER AS ordinal FROM events WHERE event_id IS NOT NULL),
px AS (SELECT e, job_id, ordinal, unnest(range(36, 90)) AS i FROM f),
df AS (SELECT e, job_id, ordinal, i, (e * 7 + i * 13) % 200 AS a, CASE WHEN e % 11 <> 3 AND i % 9 < e % 6 THEN ((e * 7 + i * 13) % 200 + 20 + e % 10) % 256 ELSE (e * 7 + i * 13) % 200 END AS b FROM px),
ratio AS (SELECT job_id, ordinal, CASE WHEN any_value(e) % 29 <> 5 THEN count(*) FILTER (WHERE abs(a - b) >= 25) / 54.0::DOUBLE END AS ratio, any_value(e) AS e FROM df GROUP BY job_id, ordinal)"""


def _frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(source, burned) frames of eight events a job: some burned ones are missing, empty or of another size, some have no overlay."""
    e = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").filter("event_id is not null").select("event_id", F.floor(e / 8).cast("string").alias("job_id"), (e % 8).cast("int").alias("ordinal"))
    # A picture depends on the event's number modulo 6,600 alone: with an overlay on its remainder by 600, else by 200.
    pixels = lambda table, n: F.substring(F.lit(table), (F.pmod(e, F.lit(n)) * PICTURE + 1).cast("int"), F.lit(PICTURE))
    plain, overlaid = pixels(PLAIN, 200), F.when(e % 11 != 3, pixels(OVERLAID, 600)).otherwise(pixels(PLAIN, 200))
    size = lambda w: [w.alias("width"), F.lit(HEIGHT).alias("height")]
    source = rows.select("job_id", "ordinal", *size(F.lit(WIDTH)), plain.alias("pixels"))
    burned = rows.filter(e % 97 != 8).select("job_id", "ordinal", *size(F.when(e % 29 == 5, WIDTH + 1).otherwise(F.lit(WIDTH))), F.when(e % 83 == 9, F.unhex(F.lit(""))).otherwise(overlaid).alias("pixels"))
    return source, burned


@query(
    f"WITH {SQL_FRAMES}, j AS (SELECT job_id, bool_or(e % 97 = 8) AS lost, bool_or(e % 83 = 9 AND e % 97 <> 8) AS hollow, bool_or(e % 29 = 5 AND e % 97 <> 8) AS odd, min(ratio) AS least FROM ratio GROUP BY job_id), "
    "r AS (SELECT job_id, unnest([CASE WHEN lost OR hollow THEN 'cue frame sampling failed' END, CASE WHEN NOT lost AND NOT hollow AND odd THEN 'sampled frame comparison failed' END, CASE WHEN lost OR hollow OR odd OR least < 0.002 THEN 'burned cue frames lack visible overlay evidence' END]) AS rule FROM j) SELECT job_id, rule FROM r WHERE rule IS NOT NULL"
)
def frame_evidence(spark, sf_dir):
    source, burned = _frames(spark, sf_dir)
    return evidence.frame_gate(source.select("job_id").distinct(), source, burned)


@query(f"WITH {SQL_FRAMES} SELECT job_id, ordinal, round(ratio, 9) AS ratio FROM ratio WHERE e % 97 <> 8 AND e % 83 <> 9 UNION ALL SELECT job_id, ordinal, NULL::DOUBLE FROM ratio WHERE e % 97 <> 8 AND e % 83 = 9")
def frame_ratios(spark, sf_dir):
    return evidence.compare_frames(*_frames(spark, sf_dir)).select("job_id", "ordinal", F.round("ratio", 9).alias("ratio"))


def _contracts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, files, reports): a job for each document, its artifacts of the document's text and length, some gone, changed or ragged."""
    d = views.table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.col("doc_id").cast("string").alias("job_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    d = d.dropDuplicates(["job_id"])
    n_frames = (F.col("n") % 3 + 1).cast("int")
    frames = lambda side, k: F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(F.concat(F.lit(f"validation/{side}/"), i, F.lit(".png")).alias("path"), F.col("h").alias("sha256")))
    sampled = F.when(F.col("d") % 17 == 4, F.array().cast("array<struct<path:string,sha256:string>>")).otherwise(frames("frames", n_frames))
    ratios = F.transform(F.sequence(F.lit(1), F.when(F.col("d") % 13 == 5, n_frames + 1).otherwise(n_frames)), lambda i: F.when((F.col("d") % 11 == 6) & (i == 1), 0.0001).otherwise(0.25))
    body = F.to_json(F.struct(F.when(F.col("d") % 7 == 3, "BLOCKED").otherwise("PASS").alias("quality_status"), sampled.alias("sampled_frames"), frames("source-frames", n_frames).alias("source_sampled_frames"), ratios.alias("burned_lower_frame_difference_ratio")))
    reports = d.select("job_id", F.lit("validation/report.json").alias("path"), F.when(F.col("d") % 19 == 7, "no json").otherwise(body).alias("content"))
    for k, p in enumerate(evidence.PASSING):
        reports = reports.union(d.select("job_id", F.lit(p).alias("path"), F.when(F.col("d") % 23 == k, '{"status": "BLOCKED"}').otherwise('{"status": "PASS"}').alias("content")))
    named = (*evidence.REQUIRED, *evidence.PASSING)
    paths = F.array(*[F.lit(p) for p in named], F.lit("source/source.mkv"), F.lit("output/soft-subtitled.mp4"))
    files = d.select("d", "job_id", "h", F.posexplode(paths).alias("k", "path")).filter((F.col("d") + F.col("k")) % 41 != 0).select("job_id", "path", F.col("h").alias("sha256"))
    files = files.union(d.filter("d % 31 = 8").select("job_id", F.lit("output/soft-subtitled.mkv"), "h"))
    for side in ("frames", "source-frames"):
        one = d.select("d", "job_id", "h", F.explode(F.sequence(F.lit(1), n_frames)).alias("i"))
        files = files.union(one.filter((F.col("d") + F.col("i")) % 37 != 0).select("job_id", F.concat(F.lit(f"validation/{side}/"), "i", F.lit(".png")), F.when(F.col("d") % 29 == 9, "changed").otherwise(F.col("h"))))
    return d.select("job_id"), files, reports


_NAMED = (*evidence.REQUIRED, *evidence.PASSING)


@query(
    "WITH d AS (SELECT DISTINCT doc_id AS d, doc_id::VARCHAR AS job_id, coalesce(length(text), 0) % 3 + 1 AS n FROM documents WHERE doc_id IS NOT NULL), "
    f"p AS (SELECT unnest([{', '.join(repr(x) for x in (*_NAMED, 'source/source.mkv', 'output/soft-subtitled.mp4'))}]) AS path, unnest(range({len(_NAMED) + 2})) AS k), fr AS (SELECT d, job_id, n, unnest(['sampled_frames', 'source_sampled_frames']) AS field FROM d WHERE d % 19 <> 7), "
    "breach AS ("
    "SELECT job_id, 'QUALITY_NOT_PASSING' AS code, 'validation/report.json' AS field, NULL::INTEGER AS place, 'not passing' AS rule FROM d WHERE d % 7 = 3 OR d % 19 = 7 "
    f"UNION ALL SELECT job_id, 'QUALITY_NOT_PASSING', path, NULL, 'not passing' FROM d JOIN (SELECT unnest([{', '.join(repr(x) for x in evidence.PASSING)}]) AS path, unnest(range(4)) AS k) ON d % 23 = k "
    "UNION ALL SELECT job_id, 'VALIDATION_EVIDENCE_INVALID', f, NULL, r FROM (SELECT job_id, unnest(['sampled_frames', 'source_sampled_frames', 'burned_lower_frame_difference_ratio']) AS f, unnest(['no frames', 'no frames', 'not as many as frames']) AS r FROM d WHERE d % 19 = 7) "
    "UNION ALL SELECT job_id, 'VALIDATION_EVIDENCE_INVALID', 'sampled_frames', NULL, 'no frames' FROM d WHERE d % 17 = 4 AND d % 19 <> 7 "
    "UNION ALL SELECT job_id, 'VALIDATION_EVIDENCE_INVALID', field, (i - 1)::INTEGER, CASE WHEN (d + i) % 37 = 0 THEN 'file missing' ELSE 'file changed' END FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM fr WHERE NOT (field = 'sampled_frames' AND d % 17 = 4)) WHERE (d + i) % 37 = 0 OR d % 29 = 9 "
    "UNION ALL SELECT job_id, 'VALIDATION_EVIDENCE_INVALID', 'burned_lower_frame_difference_ratio', NULL, 'not as many as frames' FROM d WHERE d % 19 <> 7 AND (d % 13 = 5 OR d % 17 = 4) "
    "UNION ALL SELECT job_id, 'VALIDATION_EVIDENCE_INVALID', 'burned_lower_frame_difference_ratio', 0, 'below minimum' FROM d WHERE d % 19 <> 7 AND d % 11 = 6 "
    "UNION ALL SELECT job_id, 'COMPLETION_ARTIFACT_MISSING', CASE path WHEN 'source/source.mkv' THEN 'source/source.*' WHEN 'output/soft-subtitled.mp4' THEN 'output/soft-subtitled.*' ELSE path END, NULL, 'missing' FROM d JOIN p ON (d + k) % 41 = 0 WHERE NOT (path = 'output/soft-subtitled.mp4' AND d % 31 = 8) "
    f"UNION ALL SELECT job_id, 'COMPLETION_ARTIFACT_MISSING', 'output/soft-subtitled.*', NULL, 'more than one' FROM d WHERE d % 31 = 8 AND (d + {len(_NAMED) + 1}) % 41 <> 0) "
    "SELECT * FROM breach"
)
def manifest_breaches(spark, sf_dir):
    return evidence.manifest_contract(*_contracts(spark, sf_dir))


#: levenshtein() counts bytes, so characters beyond ASCII become ones that folded tokens never hold.
@query(
    "WITH e AS (SELECT doc_id AS id, unnest(['head', 'tail']) AS side, unnest([left(text, 100), right(text, 100)]) AS k FROM documents WHERE length(text) >= 100 AND doc_id IS NOT NULL), "
    "f AS (SELECT id, side, min(id) OVER (PARTITION BY side, k) AS other FROM e), p AS (SELECT * FROM f WHERE id <> other), "
    f"t AS (SELECT doc_id AS id, array_to_string({TOKENS.format('text')}, '') AS x FROM documents WHERE doc_id IN (SELECT id FROM p UNION SELECT other FROM p)), "
    "beyond AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS far FROM (SELECT DISTINCT unnest(string_split(x, '')) AS c FROM t) WHERE strlen(c) > 1), "
    "y AS (SELECT id, length(x) AS n, translate(x, far, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~', 1, length(far))) AS x FROM t, beyond), "
    "d AS (SELECT p.id, p.side, p.other, o.n, m.n AS m, levenshtein(o.x, m.x) AS distance FROM p JOIN y m ON m.id = p.id JOIN y o ON o.id = p.other) "
    "SELECT id AS doc_id, side, other AS other_id, n::BIGINT AS n_chars, distance::BIGINT AS distance, round(CASE WHEN n = 0 THEN (m > 0)::INT::DOUBLE ELSE distance / n::DOUBLE END, 9) AS cer FROM d"
)
def near_copy_cer(spark, sf_dir):
    """Distances of documents' near copies, over whole texts."""
    d = metrics.near_copy_errors(views.table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "side", F.col("other").alias("other_id"), F.col("n_chars").cast("bigint").alias("n_chars"), "distance", F.round("cer", 9).alias("cer"))


@query(
    "WITH rec AS (SELECT (event_id // 40)::VARCHAR AS job_id, event_id, list_extract(['acquire', 'normalize', 'prepare-eval', 'evaluate-asr', 'transcribe', 'translate', 'subtitles', 'render', 'validate', 'manifest'], (event_id % 10 + 1)::BIGINT) AS stage, "
    "CASE WHEN event_id % 53 = 0 THEN 'blocked' WHEN event_id % 47 = 0 THEN 'running' ELSE 'complete' END AS status FROM events WHERE event_id IS NOT NULL), "
    "st AS (SELECT job_id, event_id, CASE WHEN status = 'blocked' THEN 'blocked' WHEN status = 'complete' AND stage = 'manifest' THEN 'complete' ELSE 'in_progress' END AS s FROM rec), ch AS (SELECT *, lag(s) OVER (PARTITION BY job_id ORDER BY event_id) AS p FROM st) "
    "SELECT job_id, arg_max(s, event_id) AS status, count(*) FILTER (WHERE p IS NULL OR p <> s)::BIGINT AS changes FROM ch GROUP BY job_id"
)
def stream_job_changes(spark, sf_dir):
    """Events as a stream, every third of them twice: what each job has come to, and how often it changed."""
    schema = views.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).filter("event_id is not null")
    n = F.col("event_id")
    twice = e.withColumn("copy", F.explode(F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    status = F.when(n % 53 == 0, "blocked").when(n % 47 == 0, "running").otherwise("complete")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("acquire", *ledger.ALL_STAGES)]), (n % 10 + 1).cast("int"))
    log = twice.select(F.floor(n / 40).cast("string").alias("job_id"), stage.alias("stage"), status.alias("status"), F.when(n % 53 == 0, "X").alias("code"), n.cast("string").alias("attempt"), F.timestamp_seconds(n + 1_600_000_000).alias("at"))
    folder = f"{shared_folder(spark)}/captionloom-jobs-{uuid.uuid4().hex}"
    return job_stream.follow(job_stream.job_changes(log), folder).select("job_id", "status", "changes")


@query(
    "SELECT event_id, CASE WHEN event_id % 37 = 1 THEN 'not a record' WHEN event_id % 41 = 2 THEN 'no job' WHEN event_id % 43 = 3 THEN 'unknown stage' WHEN event_id % 47 = 4 THEN 'unknown status' WHEN event_id % 53 = 5 THEN 'no time' WHEN event_id % 5 = 2 AND event_id % 59 < 30 THEN 'no code' WHEN event_id % 61 = 6 THEN 'output incomplete' WHEN event_id % 67 = 7 THEN 'not a record' END AS rule FROM events WHERE event_id IS NOT NULL"
)
def state_shapes(spark, sf_dir):
    """Lines of a job-state log, one an event, damaged in every way that is told apart."""
    n = F.col("event_id")
    e = views.table(spark, sf_dir, "events").filter("event_id is not null")
    status = F.when(n % 5 == 2, "blocked").otherwise("complete")
    out = F.struct(F.lit("out").alias("path"), F.when(n % 61 == 6, -1).otherwise(n).alias("bytes"), F.lit("h").alias("sha256"))
    line = F.to_json(
        F.struct(
            F.when(n % 41 == 2, " ").otherwise(n.cast("string")).alias("job_id"), F.when(n % 43 == 3, "no-stage").otherwise("translate").alias("stage"), F.when(n % 47 == 4, "done").otherwise(status).alias("status"),
            F.when(n % 53 == 5, "soon").otherwise("2026-01-01T00:00:00+00:00").alias("recorded_at"), F.when((n % 5 == 2) & (n % 59 >= 30), "X").alias("code"), F.array(out).alias("outputs"), F.lit(1).alias("extra"),
        )
    )
    wrong = F.when(n % 37 == 1, F.when(n % 2 == 0, "no json").otherwise("[]")).when(n % 67 == 7, '{"job_id": "a", "stage": "translate", "status": "complete", "recorded_at": "2026-01-01T00:00:00Z", "outputs": "none"}').otherwise(line)
    # A line damaged in two ways is told by the first of the rules; the last damage would hide the others.
    hidden = (n % 41 == 2) | (n % 43 == 3) | (n % 47 == 4) | (n % 53 == 5) | ((n % 5 == 2) & (n % 59 < 30)) | (n % 61 == 6)
    lines = e.select("event_id", F.when((n % 67 == 7) & hidden & (n % 37 != 1), line).otherwise(wrong).alias("value"))
    return ledger.decode_states(lines, carry=("event_id",)).select("event_id", "rule")


@query(f"WITH {views.SQL_SEGMENTS}, {SQL_CUES}, n AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS seq, start_ms, end_ms, text FROM cue) SELECT job_id, 'en.srt' AS file, md5({SQL_SRT}) AS digest FROM n GROUP BY job_id UNION ALL SELECT job_id, 'en.vtt', md5({SQL_VTT}) FROM n GROUP BY job_id")
def published_captions(spark, sf_dir):
    """Both caption files of every job, written by the sink of files and read back from where they are."""
    cues = _plain_cues(views.segments(spark, sf_dir))
    made = [f(cues, ["job_id"]).select("job_id", F.lit(p).alias("path"), "content") for f, p in ((captions.render_srt, "en.srt"), (captions.render_vtt, "en.vtt"))]
    folder = f"{shared_folder(spark)}/captionloom-published-{uuid.uuid4().hex}"
    publish.publish(made[0].union(made[1]), folder)
    # What is read back is content, not text: line ends and the last character count.
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    place = F.split("path", "/")
    return read.select(F.element_at(place, -2).alias("job_id"), F.element_at(place, -1).alias("file"), F.md5("content").alias("digest"))
