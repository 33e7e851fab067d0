"""Registered queries over the sample tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionloom.functions import redaction
from captionloom.functions.text import char_distance, contains_term, format_timestamp, is_blank, numbers, parse_timestamp, tokens
from captionloom.operators import cues as cue_ops
from captionloom.operators import intervals, metrics, transcripts, translation
from captionloom.plans import ledger, rereads, views
from captionloom.plans.views import SQL_CANDIDATES, SQL_SEGMENTS, SQL_TRANSLATIONS
from captionloom.session import shared_folder
from captionloom.sources import captions
from captionloom.streaming import events as event_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
POLICY = cue_ops.Policy()
SECONDS = "round({} / 1000.0, 6)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(c) -> F.Column:
    return c.cast("bigint")


FOLD = "replace(lower(nfc_normalize({})), 'ß', 'ss')"
TOKENS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, seq, len({TOKENS.format('text')})::BIGINT AS n_tokens, length(list_aggregate({TOKENS.format('text')} || [''], 'string_agg', ''))::BIGINT AS n_chars, md5(list_aggregate({TOKENS.format('text')} || [''], 'string_agg', ' ')) AS digest FROM seg")
def tokenize_words(spark, sf_dir):
    t = views.segments(spark, sf_dir).select("job_id", "seq", tokens(F.col("text")).alias("t"))
    return t.select("job_id", "seq", _long(F.size("t")).alias("n_tokens"), _long(F.length(F.array_join("t", ""))).alias("n_chars"), F.md5(F.concat(F.array_join("t", " "), F.when(F.size("t") > 0, " ").otherwise(""))).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[\p{L}\p{N}]+'))::BIGINT AS n_tokens, coalesce(length(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')), 0)::BIGINT AS n_chars FROM documents")
def tokenize_documents(spark, sf_dir):
    t = views.table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", _long(F.size("t")).alias("n_tokens"), _long(F.length(F.array_join("t", ""))).alias("n_chars"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, seq, id, start_ms, end_ms, round(confidence, 6) AS confidence FROM seg")
def segment_timeline(spark, sf_dir):
    return views.segments(spark, sf_dir).select("job_id", "seq", "id", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, coalesce(string_agg(trim(text), ' ' ORDER BY seq) FILTER (WHERE trim(text) <> ''), '') AS text FROM seg GROUP BY job_id")
def transcript_text(spark, sf_dir):
    return metrics.transcript_text(views.segments(spark, sf_dir), ["job_id"])


def _pairs(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    a = metrics.transcript_text(segs, ["job_id"]).select("job_id", tokens(F.col("text")).alias("expected"))
    b = metrics.transcript_text(views.candidates(segs), ["job_id", "candidate"]).select("job_id", "candidate", tokens(F.col("text")).alias("got"))
    return metrics.spread(b.join(a, "job_id"), "job_id", "candidate")


SQL_TEXTS = f"""{SQL_SEGMENTS}, {SQL_CANDIDATES},
ours AS (SELECT job_id, coalesce(string_agg(trim(text), ' ' ORDER BY seq) FILTER (WHERE trim(text) <> ''), '') AS text FROM seg GROUP BY ALL),
theirs AS (SELECT job_id, candidate, coalesce(string_agg(trim(text), ' ' ORDER BY seq) FILTER (WHERE trim(text) <> ''), '') AS text FROM cand GROUP BY ALL)"""

#: Word distances row by row of the table of distances; a row's running minimum stands for the step from the left.
SQL_WER = f"""
pair AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t.job_id, candidate)::INTEGER AS p, t.job_id, candidate, {TOKENS.format('o.text')} AS e, {TOKENS.format('t.text')} AS g FROM theirs t JOIN ours o USING (job_id)),
word AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY w)::INTEGER AS code FROM (SELECT DISTINCT unnest(e || g) AS w FROM pair)),
ew AS MATERIALIZED (SELECT p, i, code FROM (SELECT p, unnest(range(1, len(e) + 1))::INTEGER AS i, unnest(e) AS w FROM pair) JOIN word USING (w)),
gw AS MATERIALIZED (SELECT p, j, code FROM (SELECT p, unnest(range(1, len(g) + 1))::INTEGER AS j, unnest(g) AS w FROM pair) JOIN word USING (w)),
dp(p, i, j, code, d) AS (SELECT p, 0, 0, 0, 0 FROM pair UNION ALL SELECT p, 0, j, code, j FROM gw),
table_of(p, i, j, code, d) AS (SELECT * FROM dp UNION ALL
  SELECT p, i + 1, j, code, (min(t - j) OVER (PARTITION BY p ORDER BY j) + j)::INTEGER FROM (
    SELECT m.p, m.i, m.j, m.code, least(m.d + 1, coalesce(lag(m.d) OVER (PARTITION BY m.p ORDER BY m.j) + (m.code <> ew.code)::INTEGER, m.d + 1)) AS t FROM table_of m JOIN ew ON ew.p = m.p AND ew.i = m.i + 1)),
wd AS (SELECT job_id, candidate, len(e)::BIGINT AS n_words, CASE WHEN len(e) = 0 THEN (len(g) > 0)::INT::DOUBLE ELSE d / len(e)::DOUBLE END AS wer FROM table_of JOIN pair USING (p) WHERE i = len(e) AND j = len(g))"""

#: Character distances: levenshtein() counts bytes, so characters beyond ASCII become ones that folded tokens never hold.
SQL_CER = f"""
chars AS (SELECT job_id, candidate, array_to_string({TOKENS.format('o.text')}, '') AS x, array_to_string({TOKENS.format('t.text')}, '') AS y FROM theirs t JOIN ours o USING (job_id)),
beyond AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS far FROM (SELECT DISTINCT unnest(string_split(x || y, '')) AS c FROM chars) WHERE strlen(c) > 1),
plain AS (SELECT job_id, candidate, length(x) AS n, length(y) AS m, translate(x, far, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{{|}}~', 1, length(far))) AS x, translate(y, far, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{{|}}~', 1, length(far))) AS y FROM chars, beyond),
cd AS (SELECT job_id, candidate, n::BIGINT AS n_chars, CASE WHEN n = 0 THEN (m > 0)::INT::DOUBLE ELSE levenshtein(x, y) / n::DOUBLE END AS cer FROM plain)"""


@query(f"WITH RECURSIVE {SQL_TEXTS}, {SQL_WER} SELECT job_id, candidate, n_words, round(wer, 6) AS wer FROM wd")
def wer_by_candidate(spark, sf_dir):
    return _pairs(spark, sf_dir).select("job_id", "candidate", _long(F.size("expected")).alias("n_words"), F.round(metrics.word_error_rate(F.col("expected"), F.col("got")), 6).alias("wer"))


@query(f"WITH {SQL_TEXTS}, {SQL_CER} SELECT job_id, candidate, n_chars, round(cer, 6) AS cer FROM cd")
def cer_by_candidate(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.select("job_id", "candidate", _long(F.length(F.array_join("expected", ""))).alias("n_chars"), F.round(metrics.char_error_rate(F.col("expected"), F.col("got")), 6).alias("cer"))


SQL_RECALL = "(SELECT avg(CASE WHEN contains(' ' || list_aggregate({tok} || ['#'], 'string_agg', ' ') || ' ', ' ' || t || ' ') THEN 1.0 ELSE 0.0 END) FROM (SELECT unnest([{terms}]) AS t))"


@query(
    f"WITH {SQL_TEXTS} SELECT job_id, candidate, round({SQL_RECALL.format(tok=TOKENS.format('text'), terms=', '.join(repr(t) for t in views.TERMS))}, 6) AS glossary_term_recall, "
    f"round({SQL_RECALL.format(tok=TOKENS.format('text'), terms=', '.join(repr(t) for t in views.NUMBERS))}, 6) AS number_recall FROM theirs"
)
def term_recall(spark, sf_dir):
    split = lambda terms: F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.split(t, " "))
    rows = _pairs(spark, sf_dir)
    return rows.select("job_id", "candidate", F.round(metrics.term_recall(split(views.TERMS), F.col("got")), 6).alias("glossary_term_recall"), F.round(metrics.term_recall(split(views.NUMBERS), F.col("got")), 6).alias("number_recall"))


SQL_PUNCTUATION = r"""
a AS (SELECT job_id, mark, count(*) AS n FROM (SELECT job_id, unnest(regexp_extract_all(text, '\p{P}')) AS mark FROM ours) GROUP BY ALL),
b AS (SELECT job_id, candidate, mark, count(*) AS m FROM (SELECT job_id, candidate, unnest(regexp_extract_all(text, '\p{P}')) AS mark FROM theirs) GROUP BY ALL),
na AS (SELECT job_id, sum(n) AS a FROM a GROUP BY ALL), nb AS (SELECT job_id, candidate, sum(m) AS b FROM b GROUP BY ALL),
nh AS (SELECT job_id, candidate, sum(least(n, m)) AS h FROM b JOIN a USING (job_id, mark) GROUP BY ALL),
f1 AS (SELECT job_id, candidate, CASE WHEN coalesce(a, 0) = 0 THEN CASE WHEN coalesce(b, 0) = 0 THEN 1.0 ELSE 0.0 END WHEN coalesce(b, 0) = 0 OR coalesce(h, 0) = 0 THEN 0.0 ELSE 2.0 * h / (a + b) END AS punctuation_f1
  FROM theirs LEFT JOIN na USING (job_id) LEFT JOIN nb USING (job_id, candidate) LEFT JOIN nh USING (job_id, candidate))"""


@query(f"WITH {SQL_TEXTS}, {SQL_PUNCTUATION} SELECT job_id, candidate, round(punctuation_f1::DOUBLE, 6) AS punctuation_f1 FROM f1")
def punctuation_f1(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    made = metrics.punctuation_f1(metrics.transcript_text(segs, ["job_id"]), metrics.transcript_text(views.candidates(segs), ["job_id", "candidate"]))
    return made.select("job_id", "candidate", F.round("punctuation_f1", 6).alias("punctuation_f1"))


def _stretched(segs):
    """Segments of which every third runs on for 900 ms, so that some overlap, some touch and some stand apart."""
    return segs.withColumn("end_ms", F.col("end_ms") + F.when(F.col("k") % 3 == 0, 900).when(F.col("k") % 3 == 1, 500).otherwise(0))


SQL_UNION = """
long AS (SELECT job_id, start_ms, end_ms + CASE WHEN k % 3 = 0 THEN 900 WHEN k % 3 = 1 THEN 500 ELSE 0 END AS end_ms FROM seg),
pm AS (SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM long),
isl AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms > p THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM pm),
merged AS (SELECT job_id, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM isl GROUP BY job_id, i)"""


@query(f"WITH {SQL_SEGMENTS}, {SQL_UNION} SELECT * FROM merged")
def speech_intervals(spark, sf_dir):
    segs = _stretched(views.segments(spark, sf_dir)).select("job_id", "start_ms", "end_ms")
    return intervals.merge_intervals(segs, ["job_id"], "start_ms", "end_ms")


SQL_IOU = """
ia AS (SELECT job_id, sum(end_ms - start_ms) AS x FROM seg GROUP BY ALL), ib AS (SELECT job_id, candidate, sum(end_ms - start_ms) AS y FROM cand GROUP BY ALL),
io AS (SELECT c.job_id, c.candidate, sum(least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms)) AS o FROM cand c JOIN seg s ON c.job_id = s.job_id AND s.start_ms < c.end_ms AND c.start_ms < s.end_ms GROUP BY ALL),
iou AS (SELECT job_id, candidate, coalesce(o, 0) / (x + y - coalesce(o, 0))::DOUBLE AS timing_iou FROM ib JOIN ia USING (job_id) LEFT JOIN io USING (job_id, candidate))"""


@query(f"WITH {SQL_SEGMENTS}, {SQL_CANDIDATES}, {SQL_IOU} SELECT job_id, candidate, round(timing_iou, 6) AS timing_iou FROM iou")
def timing_iou(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return intervals.timing_iou(segs, views.candidates(segs)).select("job_id", "candidate", F.round("timing_iou", 6).alias("timing_iou"))


def _evaluations(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return metrics.evaluate(segs, views.candidates(segs), views.per_job(segs, views.TERMS, "term"), views.per_job(segs, views.NUMBERS, "number"))


SQL_RECALLS = f"""rec AS (SELECT job_id, candidate, {SQL_RECALL.format(tok=TOKENS.format('text'), terms=', '.join(repr(t) for t in views.TERMS))}::DOUBLE AS glossary_term_recall,
  {SQL_RECALL.format(tok=TOKENS.format('text'), terms=', '.join(repr(t) for t in views.NUMBERS))}::DOUBLE AS number_recall FROM theirs)"""
SQL_EVALUATED = f"{SQL_TEXTS}, {SQL_WER}, {SQL_CER}, {SQL_RECALLS}, {SQL_PUNCTUATION}, {SQL_IOU}, ev AS (SELECT * FROM wd JOIN cd USING (job_id, candidate) JOIN rec USING (job_id, candidate) JOIN f1 USING (job_id, candidate) JOIN iou USING (job_id, candidate))"
SQL_GATES = """gd AS (SELECT *, concat_ws(',', CASE WHEN wer > 0.20 THEN 'wer' END, CASE WHEN cer > 0.14 THEN 'cer' END, CASE WHEN number_recall < 1 THEN 'number_recall' END, CASE WHEN glossary_term_recall < 1 THEN 'glossary_term_recall' END, CASE WHEN timing_iou < 0.5 THEN 'timing_iou' END) AS failed_gates,
  wer + 0.35::DOUBLE * cer + 0.15::DOUBLE * (1 - glossary_term_recall) + 0.15::DOUBLE * (1 - number_recall) + 0.05::DOUBLE * (1 - punctuation_f1) + 0.10::DOUBLE * (1 - timing_iou) AS score FROM ev)"""
SQL_WINNERS = "w AS (SELECT job_id, candidate FROM gd WHERE failed_gates = '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY wer, candidate <> 'native', score, candidate) = 1)"

METRICS = ("wer", "cer", "glossary_term_recall", "number_recall", "punctuation_f1", "timing_iou")


@query(f"WITH RECURSIVE {SQL_EVALUATED} SELECT job_id, candidate, " + ", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in METRICS) + " FROM ev")
def evaluate_candidates(spark, sf_dir):
    return _evaluations(spark, sf_dir).select("job_id", "candidate", *[F.round(m, 6).alias(m) for m in METRICS])


def _judged(spark, sf_dir):
    """Evaluations of four tracks; the terms are the first and the last word of each job's own text."""
    segs = views.segments(spark, sf_dir)
    text = metrics.transcript_text(segs, ["job_id"]).select("job_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    terms = text.select("job_id", F.explode(F.array(F.element_at("t", 1), F.element_at("t", -1))).alias("term"))
    return metrics.evaluate(segs, views.tracks(segs), terms, terms.limit(0).withColumnRenamed("term", "number"))


SQL_OWN_TERMS = "rec AS (SELECT job_id, candidate, CASE WHEN len(e) = 0 THEN 1.0 ELSE (list_contains(g, e[1])::INT + list_contains(g, e[len(e)])::INT) / 2.0 END::DOUBLE AS glossary_term_recall, 1.0::DOUBLE AS number_recall FROM pair)"
SQL_JUDGED = f"{SQL_TEXTS.replace(SQL_CANDIDATES, views.SQL_TRACKS)}, {SQL_WER}, {SQL_CER}, {SQL_OWN_TERMS}, {SQL_PUNCTUATION}, {SQL_IOU}, ev AS (SELECT * FROM wd JOIN cd USING (job_id, candidate) JOIN rec USING (job_id, candidate) JOIN f1 USING (job_id, candidate) JOIN iou USING (job_id, candidate)), {SQL_GATES}"


@query(f"WITH RECURSIVE {SQL_JUDGED} SELECT job_id, candidate, failed_gates, round(score, 6) AS score, CASE WHEN failed_gates = '' THEN 'eligible' ELSE 'rejected' END AS status FROM gd")
def candidate_gates(spark, sf_dir):
    return metrics.gated(_judged(spark, sf_dir)).select("job_id", "candidate", F.array_join("failed_gates", ",").alias("failed_gates"), F.round("score", 6).alias("score"), "status")


@query(f"WITH RECURSIVE {SQL_JUDGED}, {SQL_WINNERS} SELECT j.job_id, w.candidate AS selected, CASE WHEN j.n < 2 THEN 'ASR_CANDIDATES_INSUFFICIENT' WHEN w.candidate IS NULL THEN 'ASR_QUALITY_GATES_FAILED' END AS code FROM (SELECT job_id, count(*) AS n FROM gd GROUP BY job_id) j LEFT JOIN w USING (job_id)")
def select_winner(spark, sf_dir):
    return metrics.select_winner(_judged(spark, sf_dir))


#: Of the four tracks of a job some were not to be had and some failed, by the job's number.
SQL_TRIED = "att AS (SELECT job_id, candidate, CASE WHEN (job_id::BIGINT + length(candidate)) % 7 = 0 THEN 'unavailable' WHEN (job_id::BIGINT + ascii(candidate)) % 5 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM gd)"


def _tried(evaluations):
    n = F.col("job_id").cast("long")
    outcome = F.when((n + F.length("candidate")) % 7 == 0, "unavailable").when((n + F.ascii("candidate")) % 5 == 0, "failed").otherwise("ok")
    return evaluations.select("job_id", "candidate", outcome.alias("outcome"))


@query(
    f"WITH RECURSIVE {SQL_JUDGED}, {SQL_TRIED}, ok AS (SELECT gd.* FROM gd JOIN att USING (job_id, candidate) WHERE outcome = 'ok'), n AS (SELECT job_id, count(*) FILTER (WHERE outcome = 'ok') AS n FROM att GROUP BY job_id), "
    "w AS (SELECT job_id, candidate FROM ok WHERE failed_gates = '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY wer, candidate <> 'native', score, candidate) = 1) "
    "SELECT job_id, CASE WHEN n >= 2 THEN w.candidate END AS selected, CASE WHEN n < 2 THEN 'ASR_CANDIDATES_INSUFFICIENT' WHEN w.candidate IS NULL THEN 'ASR_QUALITY_GATES_FAILED' END AS code FROM n LEFT JOIN w USING (job_id)"
)
def bake_off_of_tracks(spark, sf_dir):
    """The winner among what was to be had, from evaluations of the tracks themselves."""
    # Both sides of the choice read the evaluations, a row of figures for each track: they are made once.
    shared_folder(spark)
    judged = metrics.gated(_judged(spark, sf_dir)).checkpoint()
    return rereads.bake_off(judged, _tried(judged))


SQL_SIMPLE = "evals AS (SELECT doc_id::VARCHAR AS job_id, unnest(['native', 'a', 'b']) AS candidate, doc_id AS d FROM documents WHERE doc_id IS NOT NULL), ev AS (SELECT job_id, candidate, ((d * 7 + length(candidate) * 3) % 30) / 100.0::DOUBLE AS wer, ((d * 11 + ascii(candidate)) % 20) / 100.0::DOUBLE AS cer, CASE WHEN (d + length(candidate)) % 9 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS glossary_term_recall, 1.0::DOUBLE AS number_recall, (d % 5) / 4.0::DOUBLE AS punctuation_f1, CASE WHEN (d + ascii(candidate)) % 11 = 0 THEN 0.4 ELSE 0.5 END::DOUBLE AS timing_iou FROM evals)"


def _simple(spark, sf_dir):
    """Made-up evaluations, three for each document, that reach and miss every gate."""
    d = views.table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.explode(F.array(*[F.lit(x) for x in ("native", "a", "b")])).alias("candidate"))
    d = d.select("d", F.col("d").cast("string").alias("job_id"), "candidate", F.length("candidate").alias("n"), F.ascii("candidate").alias("c"))
    return d.select(
        "job_id", "candidate", ((F.col("d") * 7 + F.col("n") * 3) % 30 / 100).alias("wer"), ((F.col("d") * 11 + F.col("c")) % 20 / 100).alias("cer"), F.when((F.col("d") + F.col("n")) % 9 == 0, 0.5).otherwise(1.0).alias("glossary_term_recall"),
        F.lit(1.0).alias("number_recall"), (F.col("d") % 5 / 4).alias("punctuation_f1"), F.when((F.col("d") + F.col("c")) % 11 == 0, 0.4).otherwise(0.5).alias("timing_iou"),
    )


SQL_GATED = SQL_SIMPLE + ", gd AS (SELECT *, concat_ws(',', CASE WHEN wer > 0.20 THEN 'wer' END, CASE WHEN cer > 0.14 THEN 'cer' END, CASE WHEN number_recall < 1 THEN 'number_recall' END, CASE WHEN glossary_term_recall < 1 THEN 'glossary_term_recall' END, CASE WHEN timing_iou < 0.5 THEN 'timing_iou' END) AS failed_gates, wer + 0.35::DOUBLE * cer + 0.15::DOUBLE * (1 - glossary_term_recall) + 0.15::DOUBLE * (1 - number_recall) + 0.05::DOUBLE * (1 - punctuation_f1) + 0.10::DOUBLE * (1 - timing_iou) AS score FROM ev)"


@query(f"WITH {SQL_GATED} SELECT job_id, candidate, failed_gates, round(score, 6) AS score, CASE WHEN failed_gates = '' THEN 'eligible' ELSE 'rejected' END AS status FROM gd")
def gate_rules(spark, sf_dir):
    return metrics.gated(_simple(spark, sf_dir)).select("job_id", "candidate", F.array_join("failed_gates", ",").alias("failed_gates"), F.round("score", 6).alias("score"), "status")


@query(f"WITH {SQL_GATED}, w AS (SELECT job_id, candidate FROM gd WHERE failed_gates = '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY wer, candidate <> 'native', score, candidate) = 1) SELECT j.job_id, w.candidate AS selected, CASE WHEN w.candidate IS NULL THEN 'ASR_QUALITY_GATES_FAILED' END AS code FROM (SELECT DISTINCT job_id FROM gd) j LEFT JOIN w USING (job_id)")
def winner_rules(spark, sf_dir):
    return metrics.select_winner(_simple(spark, sf_dir))


SQL_DURATION = "dur AS (SELECT job_id, max(end_ms) / 1000.0::DOUBLE AS duration FROM seg GROUP BY ALL)"
POSITIONS = (0.12, 0.50, 0.82)
SQL_CLIPS = f"{SQL_DURATION}, whole AS (SELECT job_id, ceil(duration) AS duration FROM dur), pos AS (SELECT unnest([1, 2, 3]) AS ordinal, unnest({list(POSITIONS)}::DOUBLE[]) AS p), clip AS (SELECT job_id, ordinal, least(greatest(0.0::DOUBLE, duration * p - least(10.0::DOUBLE, duration / 3) / 2), greatest(0.0::DOUBLE, duration - least(10.0::DOUBLE, duration / 3))) AS s, least(10.0::DOUBLE, duration / 3) AS l FROM whole CROSS JOIN pos)"


@query(f"WITH {SQL_SEGMENTS}, {SQL_CLIPS} SELECT job_id, ordinal::INTEGER AS ordinal, round(s * 1000)::BIGINT AS start_ms, round(l * 1000)::BIGINT AS length_ms FROM clip")
def clip_plan(spark, sf_dir):
    """Over whole seconds, so that no clip's start lies half-way between milliseconds."""
    media = views.durations(views.segments(spark, sf_dir)).withColumn("duration", F.ceil("duration").cast("double"))
    plan = transcripts.clip_plan(media, list(POSITIONS), 10.0)
    return plan.select("job_id", "ordinal", _long(F.round(F.col("start") * 1000)).alias("start_ms"), _long(F.round(F.col("length") * 1000)).alias("length_ms"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, seq FROM seg s WHERE EXISTS (SELECT 1 FROM (SELECT job_id AS j, unnest([0, 20000, 60000]) AS f) c WHERE c.j = s.job_id AND s.end_ms > c.f AND s.start_ms < c.f + 10000)")
def clip_overlap_segments(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    windows = segs.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(x) for x in (0, 20000, 60000)])).alias("from")).withColumn("to", F.col("from") + 10000)
    return intervals.overlapping(segs, windows, "job_id").select("job_id", "seq")


@query(f"WITH {SQL_SEGMENTS}, {SQL_DURATION}, ch AS (SELECT job_id, duration, unnest(range(0, greatest(ceil(duration / 60), 1)::BIGINT)) AS part FROM dur) SELECT job_id, part::INTEGER AS part, (part * 60)::DOUBLE AS \"offset\", round(least(60.0::DOUBLE, duration - part * 60), 6) AS length FROM ch")
def chunk_offsets(spark, sf_dir):
    return transcripts.chunk_plan(views.durations(views.segments(spark, sf_dir)), 60).select("job_id", "part", "offset", F.round("length", 6).alias("length"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY k % 2, seq) - 1)::INTEGER AS seq, 'part' || (k % 2) || '-' || id AS id, (start_ms + (k % 2) * 600000)::BIGINT AS start_ms FROM seg")
def merged_parts(spark, sf_dir):
    segs = views.in_seconds(views.segments(spark, sf_dir)).withColumn("part", (F.col("k") % 2).cast("int"))
    moved = transcripts.offset_segments(segs, F.col("part") * F.lit(600.0), F.concat(F.lit("part"), F.col("part").cast("string")))
    return transcripts.merge_parts(moved).select("job_id", "seq", "id", _long(F.round(F.col("start") * 1000)).alias("start_ms"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, seq, ((row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 3)::INTEGER AS batch FROM seg")
def translation_batches(spark, sf_dir):
    return translation.batches(views.segments(spark, sf_dir), 3).select("job_id", "seq", "batch")


def _damaged(segs):
    """Segments with repeated ids, blank texts, times out of order and beyond the media, and odd confidences."""
    k = F.col("k")
    bad = views.in_seconds(segs).withColumn("id", F.when(k % 29 == 5, F.lit("again")).otherwise(F.col("id"))).withColumn("text", F.when(k % 31 == 6, F.lit(" \t\n")).otherwise(F.col("text")))
    bad = bad.withColumn("start", F.when(k % 11 == 3, F.lit(0.001)).when(k % 37 == 2, F.lit(float("nan"))).otherwise(F.col("start")))
    return bad.withColumn("end", F.when(k % 13 == 4, F.lit(1e6)).otherwise(F.col("end"))).withColumn("confidence", F.when(k % 41 == 1, F.lit(1.5)).otherwise(F.col("confidence")))


SQL_DAMAGED = f"""{SQL_DURATION},
bad AS (SELECT job_id, seq, CASE WHEN k % 29 = 5 THEN 'again' ELSE id END AS id, CASE WHEN k % 31 = 6 THEN '' ELSE trim(text) END AS text, CASE WHEN k % 11 = 3 THEN 0.001 WHEN k % 37 = 2 THEN NULL ELSE start_ms / 1000.0::DOUBLE END::DOUBLE AS s,
  CASE WHEN k % 13 = 4 THEN 1000000.0 ELSE end_ms / 1000.0::DOUBLE END::DOUBLE AS e, CASE WHEN k % 41 = 1 THEN 1.5 ELSE confidence END AS conf, duration FROM seg JOIN dur USING (job_id)),
ins AS (SELECT *, s IS NOT NULL AND s >= 0 AND e > s AND e <= duration + 1 AS inside, row_number() OVER (PARTITION BY job_id, id ORDER BY seq) > 1 AS again FROM bad),
run AS (SELECT *, coalesce(max(CASE WHEN inside THEN s END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM ins)"""


@query(
    f"WITH {SQL_SEGMENTS}, {SQL_DAMAGED} SELECT job_id, seq, 'duplicate identifier' AS rule FROM run WHERE again UNION ALL SELECT job_id, seq, 'empty text' FROM run WHERE text = '' "
    "UNION ALL SELECT job_id, seq, CASE WHEN s IS NULL THEN 'non-finite timing' WHEN NOT inside THEN 'invalid media bounds' ELSE 'out-of-order timing' END FROM run WHERE s IS NULL OR NOT inside OR s < before UNION ALL SELECT job_id, seq, 'invalid confidence' FROM run WHERE conf < 0 OR conf > 1"
)
def transcript_validation(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return transcripts.validate_segments(_damaged(segs), views.durations(segs))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, seq, confidence < 0.65 AS flagged FROM seg")
def confidence_enrichment(spark, sf_dir):
    flagged = transcripts.flag_low_confidence(views.segments(spark, sf_dir), 0.65)
    return flagged.select("job_id", "seq", F.array_contains("uncertainty", "low_segment_confidence").alias("flagged"))


@query(f"WITH {SQL_SEGMENTS}, v AS (SELECT *, -(k % 20) / 10.0::DOUBLE AS lp, (k % 30) / 10.0::DOUBLE AS cr, (k % 10) / 10.0::DOUBLE AS ns FROM seg) SELECT job_id, 'ow-' || (row_number() OVER (PARTITION BY job_id ORDER BY seq)) AS id, round(exp(least(0.0::DOUBLE, lp)), 6) AS confidence, concat_ws(',', CASE WHEN lp < -1.0 THEN 'low_log_probability' END, CASE WHEN cr > 2.4 THEN 'high_compression_ratio' END, CASE WHEN ns > 0.6 THEN 'possible_silence' END) AS flags FROM v")
def scored_segment_flags(spark, sf_dir):
    k = F.col("k")
    item = F.struct("seq", F.col("seq").alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", (-(k % 20) / 10).alias("avg_logprob"), (k % 30 / 10).alias("compression_ratio"), (k % 10 / 10).alias("no_speech_prob"))
    payloads = views.segments(spark, sf_dir).groupBy("job_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("segments"))).alias("payload"))
    return transcripts.parse_scored_segments(payloads).select("job_id", "id", F.round("confidence", 6).alias("confidence"), F.array_join("uncertainty", ",").alias("flags"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, 'dg-' || (row_number() OVER (PARTITION BY job_id ORDER BY seq)) AS id, len(string_split(text, ' '))::BIGINT AS n_words, concat_ws(',', CASE WHEN confidence < 0.65 THEN 'low_segment_confidence' END, CASE WHEN k % 10 < 3 THEN 'low_word_confidence' END, CASE WHEN trim(text) = '' THEN 'empty_segment' END) AS flags FROM seg")
def utterance_flags(spark, sf_dir):
    k = F.col("k")
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), F.upper(w).alias("punctuated_word"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.when(k % 10 < 3, 0.5).otherwise(0.9).alias("confidence")))
    item = F.struct("seq", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "confidence", F.col("text").alias("transcript"), words.alias("words"))
    payloads = views.segments(spark, sf_dir).groupBy("job_id").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("utterances")).alias("results"))).alias("payload"))
    return transcripts.parse_utterances(payloads, 0.65).select("job_id", "id", _long(F.size("words")).alias("n_words"), F.array_join("uncertainty", ",").alias("flags"))


@query(
    f"WITH {SQL_SEGMENTS}, {SQL_TRANSLATIONS}, odd AS (SELECT job_id, id FROM tr UNION ALL SELECT job_id, id FROM tr WHERE k % 7 = 2 UNION ALL SELECT job_id, id || '-more' FROM tr WHERE k % 11 = 5), "
    "a AS (SELECT job_id, id, count(*) AS n FROM src GROUP BY ALL), b AS (SELECT job_id, id, count(*) AS m FROM odd GROUP BY ALL) "
    "SELECT job_id, count(*) FILTER (WHERE m IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE n IS NULL)::BIGINT AS extra, count(*) FILTER (WHERE n > 1 OR m > 1)::BIGINT AS duplicates FROM a FULL JOIN b USING (job_id, id) GROUP BY job_id"
)
def translation_id_diff(spark, sf_dir):
    """Translations of which some are missing, some come twice and some have ids that the source lacks."""
    segs = views.segments(spark, sf_dir)
    made = views.translations(segs).join(segs.select("job_id", "id", "k"), ["job_id", "id"])
    odd = made.select("job_id", "id").union(made.filter("k % 7 = 2").select("job_id", "id")).union(made.filter("k % 11 = 5").select("job_id", F.concat("id", F.lit("-more"))))
    return translation.id_differences(segs, odd)


@query(f"WITH {SQL_SEGMENTS}, {SQL_TRANSLATIONS} SELECT job_id, count(t.id) / count(*)::DOUBLE AS coverage FROM src LEFT JOIN tr t USING (job_id, id) GROUP BY job_id")
def translation_coverage(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return translation.coverage(segs, views.translations(segs))


@query(
    f"WITH {SQL_SEGMENTS}, {SQL_TRANSLATIONS}, hole AS (SELECT DISTINCT job_id FROM src WHERE k % 23 = 0), b AS (SELECT s.*, t.\"start\" AS ts, t.flagged AS tf FROM src s JOIN tr t USING (job_id, id) WHERE s.job_id NOT IN (SELECT job_id FROM hole)) "
    "SELECT job_id, NULL::INTEGER AS seq, 'translation coverage is incomplete' AS rule FROM hole UNION ALL SELECT job_id, seq, 'timing changed' FROM b WHERE abs(ts - \"start\") > 0.001 UNION ALL SELECT job_id, seq, 'source uncertainty was dropped' FROM b WHERE flagged AND NOT tf UNION ALL SELECT job_id, seq, 'unexpected number 42' FROM b WHERE k % 17 = 2 UNION ALL SELECT job_id, seq, 'empty translation' FROM b WHERE trim(text) = '' AND k % 17 <> 2"
)
def translation_validation(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return translation.validate_translation(views.in_seconds(segs), views.translations(segs), ["and"])


#: Words that are no numbers are put out of the way first: then digits joined by single marks are all there is.
SQL_NUMBERS = r"""
digits AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\p{L}\p{M}\p{N}\p{Pc}]*[\p{L}\p{M}\p{Nl}\p{No}\p{Pc}][\p{L}\p{M}\p{N}\p{Pc}]*', 'x', 'g'), '\d+(?:[.,]\d+)*') AS found FROM documents),
tok AS (SELECT doc_id, t, replace(replace(t, '.', ''), ',', '.') AS x, replace(t, ',', '') AS y FROM (SELECT doc_id, unnest(found) AS t FROM digits)),
canon AS (SELECT doc_id,
  CASE WHEN regexp_full_match(x, '\d+(\.\d+)?') THEN regexp_replace(regexp_replace(regexp_replace(x, '^0+(\d)', '\1'), '(\.\d*?)0+$', '\1'), '\.$', '') ELSE 'malformed:' || t END AS a,
  CASE WHEN regexp_full_match(y, '\d+(\.\d+)?') THEN regexp_replace(regexp_replace(regexp_replace(y, '^0+(\d)', '\1'), '(\.\d*?)0+$', '\1'), '\.$', '') ELSE 'malformed:' || t END AS b FROM tok),
ca AS (SELECT doc_id, a AS v, count(*) AS m FROM canon GROUP BY ALL), cb AS (SELECT doc_id, b AS v, count(*) AS n FROM canon GROUP BY ALL),
diff AS (SELECT doc_id, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)) AS missing, sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)) AS unexpected FROM ca FULL JOIN cb USING (doc_id, v) GROUP BY doc_id)"""


@query(f"WITH {SQL_NUMBERS} SELECT doc_id, len(found)::BIGINT AS n, coalesce(missing, 0)::BIGINT AS missing, coalesce(unexpected, 0)::BIGINT AS unexpected FROM digits LEFT JOIN diff USING (doc_id)")
def translation_number_diff(spark, sf_dir):
    """Numbers of documents read with either locale's rules: what one reading has beyond the other."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", numbers(F.col("text"), "decimal_comma").alias("a"), numbers(F.col("text"), "decimal_point").alias("b"))
    return d.select("doc_id", _long(F.size("a")).alias("n"), _long(F.size(translation.multiset_minus(F.col("a"), F.col("b")))).alias("missing"), _long(F.size(translation.multiset_minus(F.col("b"), F.col("a")))).alias("unexpected"))


@query(f"WITH {SQL_SEGMENTS}, t AS (SELECT unnest(['the', 'and', 'you', 'zz']) AS term) SELECT job_id, seq, term, list_contains({TOKENS.format('text')}, term) AS present FROM seg CROSS JOIN t")
def glossary_presence(spark, sf_dir):
    terms = F.explode(F.array(*[F.lit(t) for t in ("the", "and", "you", "zz")]))
    return views.segments(spark, sf_dir).select("job_id", "seq", "text", terms.alias("term")).select("job_id", "seq", "term", contains_term(F.col("text"), F.col("term")).alias("present"))


def _sql_wrap(table: str) -> str:
    """Words cut to a line's width, then a line filled word by word; finished lines stand before it in the same string."""
    return f"""
cut AS (SELECT job_id, seq, unnest(list_transform(range(0, greatest((length(w) - 1) // {POLICY.max_chars_per_line}, 0) + 1), lambda x: substr(w, x * {POLICY.max_chars_per_line} + 1, {POLICY.max_chars_per_line}))) AS piece, n, unnest(range(0, greatest((length(w) - 1) // {POLICY.max_chars_per_line}, 0) + 1)) AS m
  FROM (SELECT job_id, seq, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS n FROM (SELECT job_id, seq, list_filter(regexp_split_to_array(text, '[\\s\\x{{85}}\\x0b\\x1c-\\x1f\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM {table}))),
piece AS MATERIALIZED (SELECT job_id, seq, piece, row_number() OVER (PARTITION BY job_id, seq ORDER BY n, m) AS i FROM cut),
fill(job_id, seq, i, text, width) AS (SELECT job_id, seq, i, piece, length(piece) FROM piece WHERE i = 1 UNION ALL
  SELECT f.job_id, f.seq, p.i, CASE WHEN f.width + 1 + length(p.piece) <= {POLICY.max_chars_per_line} THEN f.text || ' ' || p.piece ELSE f.text || chr(10) || p.piece END,
    CASE WHEN f.width + 1 + length(p.piece) <= {POLICY.max_chars_per_line} THEN f.width + 1 + length(p.piece) ELSE length(p.piece) END FROM fill f JOIN piece p ON p.job_id = f.job_id AND p.seq = f.seq AND p.i = f.i + 1),
filled AS (SELECT job_id, seq, arg_max(text, i) AS text FROM fill GROUP BY job_id, seq)"""



@query(f"WITH RECURSIVE {SQL_SEGMENTS}, {_sql_wrap('seg')} SELECT job_id, seq, CASE WHEN f.text IS NULL THEN 0 ELSE len(string_split(f.text, chr(10))) END::BIGINT AS n_lines, coalesce(list_max(list_transform(string_split(f.text, chr(10)), lambda x: length(x))), 0)::BIGINT AS longest, md5(coalesce(f.text, '')) AS digest FROM seg LEFT JOIN filled f USING (job_id, seq)")
def wrap_lines(spark, sf_dir):
    lines = cue_ops.wrap_lines(F.col("text"), POLICY.max_chars_per_line)
    rows = views.segments(spark, sf_dir).select("job_id", "seq", lines.alias("lines"))
    longest = F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x))), F.lit(0))
    return rows.select("job_id", "seq", _long(F.size("lines")).alias("n_lines"), _long(longest).alias("longest"), F.md5(F.array_join("lines", "\n")).alias("digest"))


#: The open group of each job after every segment; a group is what its last state says.
SQL_MERGE = f"""
given AS MATERIALIZED (SELECT job_id, seq, id, "start" AS s, "end" AS e, text, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS r FROM tr),
walk(job_id, r, seq, id, s, e, text, n) AS (SELECT job_id, r, seq, id, s, e, text, 1 FROM given WHERE r = 1 UNION ALL
  SELECT job_id, r, CASE WHEN joins THEN wseq ELSE seq END, CASE WHEN joins THEN wid ELSE id END, CASE WHEN joins THEN ws ELSE s END, CASE WHEN joins THEN greatest(we, e) ELSE e END, CASE WHEN joins THEN trim(wtext || ' ' || text) ELSE text END, CASE WHEN joins THEN wn + 1 ELSE 1 END FROM (
    SELECT g.*, w.seq AS wseq, w.id AS wid, w.s AS ws, w.e AS we, w.text AS wtext, w.n AS wn, (greatest(0.001, w.e - w.s) < {POLICY.min_cue_seconds} OR length(replace(w.text, chr(10), '')) / greatest(0.001, w.e - w.s) > {POLICY.max_chars_per_second}) AND g.s - w.e <= 1.0 AS joins
    FROM walk w JOIN given g ON g.job_id = w.job_id AND g.r = w.r + 1))"""


@query(f"WITH RECURSIVE {SQL_SEGMENTS}, {SQL_TRANSLATIONS}, {SQL_MERGE} SELECT job_id, seq, arg_max(id, r) AS id, round(arg_max(s, r), 3) AS \"start\", round(arg_max(e, r), 3) AS \"end\", md5(arg_max(text, r)) AS digest, arg_max(n, r)::INTEGER AS n FROM walk GROUP BY job_id, seq")
def merge_segments(spark, sf_dir):
    made = cue_ops.merge_segments(views.translations(views.segments(spark, sf_dir)), POLICY)
    return made.select("job_id", "seq", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.md5("text").alias("digest"), "n")


def _cues(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return cue_ops.build_cues(views.translations(segs), views.durations(segs), POLICY), segs


#: Merged segments with their chunks, then one after the other: where it starts depends on where the last one ended.
SQL_LAYOUT = f"""{SQL_DURATION}, {SQL_MERGE},
merged AS (SELECT job_id, seq, arg_max(s, r) AS s, arg_max(e, r) AS e, arg_max(text, r) AS text FROM walk GROUP BY job_id, seq),
{_sql_wrap('merged')},
line AS (SELECT job_id, seq, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM filled),
chunk AS (SELECT job_id, seq, n // {POLICY.max_lines} AS k, string_agg(line, chr(10) ORDER BY n) AS text, greatest(1, sum(length(line)))::DOUBLE AS size FROM line GROUP BY ALL),
whole AS (SELECT job_id, seq, list(text ORDER BY k) AS texts, list(size ORDER BY k) AS sizes, sum(size) AS total FROM chunk GROUP BY ALL),
block AS MATERIALIZED (SELECT job_id, seq, s, least(e, duration) AS e, texts, sizes, total, len(sizes) AS n, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS r FROM whole JOIN merged USING (job_id, seq) JOIN dur USING (job_id)),
place(job_id, r, ended, begins, lens) AS (SELECT DISTINCT job_id, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE[] FROM block UNION ALL
  SELECT job_id, r, CASE WHEN fits THEN least(e, begins + list_sum(lens) + {POLICY.minimum_gap_seconds}::DOUBLE * (n - 1)) ELSE ended END, begins, CASE WHEN fits THEN lens END FROM (
    SELECT *, list_transform(range(1, n + 1), lambda i: shares[i] - CASE WHEN excess > 0 THEN least(greatest(0.0::DOUBLE, shares[i] - {POLICY.min_cue_seconds}::DOUBLE), greatest(0.0::DOUBLE, excess
      - coalesce(list_sum(list_transform(list_filter(range(1, n + 1), lambda j: shares[j] > shares[i] OR shares[j] = shares[i] AND j < i), lambda j: greatest(0.0::DOUBLE, shares[j] - {POLICY.min_cue_seconds}::DOUBLE))), 0.0::DOUBLE))) ELSE 0.0::DOUBLE END) AS lens FROM (
    SELECT *, list_sum(shares) - room AS excess FROM (
    SELECT *, list_transform(sizes, lambda x: least({POLICY.max_cue_seconds}::DOUBLE, greatest({POLICY.min_cue_seconds}::DOUBLE, room * x / total))) AS shares, e > begins AND room > 0 AS fits FROM (
    SELECT *, e - begins - {POLICY.minimum_gap_seconds}::DOUBLE * (n - 1) AS room FROM (
    SELECT b.*, p.ended, greatest(0.0::DOUBLE, b.s, coalesce(p.ended + {POLICY.minimum_gap_seconds}::DOUBLE, 0.0::DOUBLE)) AS begins FROM place p JOIN block b ON b.job_id = p.job_id AND b.r = p.r + 1)))))),
shown AS (SELECT job_id, r, begins, e, lens, texts, unnest(range(1, n + 1)) AS i FROM place JOIN block USING (job_id, r) WHERE lens IS NOT NULL),
made AS (SELECT job_id, r, i, texts[i] AS text, least(e, begins + list_sum(lens[1:i]) + {POLICY.minimum_gap_seconds}::DOUBLE * (i - 1)) AS closes,
  CASE WHEN i = 1 THEN begins ELSE least(e, begins + list_sum(lens[1:i - 1]) + {POLICY.minimum_gap_seconds}::DOUBLE * (i - 2)) + {POLICY.minimum_gap_seconds}::DOUBLE END AS opens FROM shown),
laid AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY r, i)::INTEGER AS index, opens, closes, text FROM made)"""


@query(f"WITH RECURSIVE {SQL_SEGMENTS}, {SQL_TRANSLATIONS}, {SQL_LAYOUT} SELECT job_id, index, floor(opens * 1000 + 0.0137::DOUBLE)::BIGINT AS start_ms, floor(closes * 1000 + 0.0137::DOUBLE)::BIGINT AS end_ms, md5(text) AS digest FROM laid")
def build_cues(spark, sf_dir):
    """Times in whole milliseconds; cues may begin half-way between two, so some hundredths are added before the rest is cut."""
    ms = lambda c: _long(F.floor(F.col(c) * 1000 + 0.0137))
    return _cues(spark, sf_dir)[0].select("job_id", "index", ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.md5("text").alias("digest"))


@query(
    f"WITH RECURSIVE {SQL_SEGMENTS}, {SQL_TRANSLATIONS}, {SQL_LAYOUT}, "
    "said AS (SELECT job_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '\\s+', ' ', 'g')) AS a FROM tr GROUP BY job_id), seen AS (SELECT job_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY index), '\\s+', ' ', 'g')) AS b FROM laid GROUP BY job_id) "
    "SELECT job_id, coalesce(a, '') = coalesce(b, '') AS covered FROM said FULL JOIN seen USING (job_id)"
)
def cue_coverage(spark, sf_dir):
    made, segs = _cues(spark, sf_dir)
    return cue_ops.text_coverage(views.translations(segs), made)


def _plain_cues(segs):
    return segs.select("job_id", (F.col("seq") + 1).alias("index"), (F.col("seq") + 1).alias("seq"), "start_ms", (F.col("end_ms") + F.when(F.col("k") % 5 == 0, 700).when(F.col("k") % 5 == 1, 460).otherwise(0)).alias("end_ms"), F.translate("text", "\n", " ").alias("text"))


SQL_CUES = r"cue AS (SELECT job_id, seq + 1 AS seq, start_ms, end_ms + CASE WHEN k % 5 = 0 THEN 700 WHEN k % 5 = 1 THEN 460 ELSE 0 END AS end_ms, replace(text, chr(10), ' ') AS text FROM seg)"


@query(
    f"WITH {SQL_SEGMENTS}, {SQL_CUES}, o AS (SELECT c.*, row_number() OVER w AS ordinal, lag(end_ms) OVER w AS p, d.m AS m, end_ms - start_ms AS l FROM cue c JOIN (SELECT job_id, max(end_ms) AS m FROM seg GROUP BY ALL) d USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY seq)), "
    "r AS (SELECT job_id, ordinal::INTEGER AS ordinal, unnest([CASE WHEN seq <> ordinal THEN 'non-sequential index' END, CASE WHEN start_ms < 0 OR end_ms > m + 1 OR l <= 0 THEN 'invalid media bounds' END, CASE WHEN start_ms < p - 1 THEN 'overlaps previous cue' END, CASE WHEN start_ms < p + 80 - 1 THEN 'gap below policy' END, "
    "CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(text) > 42 THEN 'line too long' END, CASE WHEN length(text) * 1000.0 / l > 20.01 THEN 'reading speed' END, CASE WHEN l > 7001 THEN 'duration too long' END, CASE WHEN l < 999 THEN 'duration too short' END]) AS rule FROM o) SELECT * FROM r WHERE rule IS NOT NULL"
)
def validate_cues(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    return cue_ops.validate_cues(views.in_seconds(_plain_cues(segs)), views.durations(segs), POLICY)


STAMP = "printf('%02d:%02d:%02d{}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
SQL_SRT = "string_agg(seq::VARCHAR || chr(10) || {} || ' --> ' || {} || chr(10) || text, chr(10) || chr(10) ORDER BY seq) || chr(10)".format(STAMP.format(",", c="start_ms"), STAMP.format(",", c="end_ms"))
SQL_VTT = "'WEBVTT' || chr(10) || chr(10) || string_agg({} || ' --> ' || {} || chr(10) || text, chr(10) || chr(10) ORDER BY seq) || chr(10)".format(STAMP.format(".", c="start_ms"), STAMP.format(".", c="end_ms"))


@query(f"WITH {SQL_SEGMENTS}, {SQL_CUES}, n AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS seq, start_ms, end_ms, text FROM cue) SELECT job_id, md5({SQL_SRT}) AS srt FROM n GROUP BY job_id")
def srt_render(spark, sf_dir):
    return captions.render_srt(_plain_cues(views.segments(spark, sf_dir)), ["job_id"]).select("job_id", F.md5("content").alias("srt"))


@query(f"WITH {SQL_SEGMENTS}, {SQL_CUES} SELECT job_id, md5({SQL_VTT}) AS vtt FROM cue GROUP BY job_id")
def vtt_render(spark, sf_dir):
    return captions.render_vtt(_plain_cues(views.segments(spark, sf_dir)), ["job_id"]).select("job_id", F.md5("content").alias("vtt"))


SQL_TRIP = f"WITH {SQL_SEGMENTS}, {SQL_CUES} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq)::INTEGER AS index, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, trim(text) AS text FROM cue WHERE trim(text) <> ''"


def _said(segs):
    return _plain_cues(segs).withColumn("text", F.trim("text")).filter("text <> ''")


@query(SQL_TRIP)
def srt_roundtrip(spark, sf_dir):
    files = captions.render_srt(_said(views.segments(spark, sf_dir)), ["job_id"])
    return captions.parse_srt(files, ["job_id"]).select("job_id", "index", "start_ms", "end_ms", "text")


@query(SQL_TRIP)
def vtt_roundtrip(spark, sf_dir):
    files = captions.render_vtt(_said(views.segments(spark, sf_dir)), ["job_id"])
    return captions.parse_vtt(files, ["job_id"]).select("job_id", "index", "start_ms", "end_ms", "text")


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, NOT bool_or(k % 17 = 3 OR k % 19 = 4) AS equal FROM seg WHERE trim(text) <> '' GROUP BY job_id")
def caption_parity(spark, sf_dir):
    """Files of which one has some cues that end a millisecond later or say something else."""
    segs = views.segments(spark, sf_dir)
    late = F.col("end_ms") + F.when(F.col("k") % 17 == 3, 1).otherwise(0)
    other = segs.withColumn("end_ms", late).withColumn("text", F.when((F.col("k") % 19 == 4) & ~is_blank(F.col("text")), F.concat("text", F.lit(" else"))).otherwise(F.col("text")))
    return captions.parity(captions.parse_srt(captions.render_srt(_said(segs), ["job_id"]), ["job_id"]), captions.parse_vtt(captions.render_vtt(_said(other), ["job_id"]), ["job_id"]), ["job_id"])


@query("SELECT event_id, event_id * 37123 % 500000000 AS ms, " + STAMP.format(",", c="(event_id * 37123 % 500000000)") + " AS stamp FROM events")
def timestamps(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", format_timestamp(F.col("event_id") * 37123 % 500_000_000, ",").alias("stamp"))
    return e.select("event_id", parse_timestamp(F.col("stamp")).alias("ms"), "stamp")


SQL_NUMBERED = "nc AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS j, count(*) OVER (PARTITION BY job_id) AS n, seq + 1 AS index, start_ms, end_ms FROM seg)"


@query(f"WITH {SQL_SEGMENTS}, {SQL_NUMBERED} SELECT DISTINCT job_id, index::INTEGER AS index, round((start_ms + end_ms) / 2000.0::DOUBLE, 6) AS \"at\" FROM nc JOIN (SELECT unnest([0, 1, 2]) AS i) ON j = round_even(i * (n - 1) / 2.0, 0)")
def frame_sample(spark, sf_dir):
    segs = views.in_seconds(views.segments(spark, sf_dir)).select("job_id", (F.col("seq") + 1).alias("index"), "start", "end")
    return cue_ops.frame_sample(segs, 3).select("job_id", "index", F.round("at", 6).alias("at"))


@query(
    f"WITH {SQL_SEGMENTS}, {SQL_CUES}, b AS (SELECT job_id, seq AS index, end_ms, coalesce(max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, start_ms FROM cue), "
    "pl AS (SELECT job_id, index, greatest(start_ms, p) AS start_ms, end_ms, p FROM b WHERE end_ms > greatest(start_ms, p)) SELECT job_id, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, index::BIGINT AS index FROM pl UNION ALL SELECT job_id, p, start_ms, NULL FROM pl WHERE start_ms > p UNION ALL SELECT job_id, max(end_ms), max(end_ms) + 2000, NULL FROM cue GROUP BY job_id"
)
def overlay_timeline(spark, sf_dir):
    cues = _plain_cues(views.segments(spark, sf_dir))
    total = cues.groupBy("job_id").agg((F.max("end_ms") + 2000).alias("total_ms"))
    return intervals.with_gaps(cues, "job_id", total).select("job_id", "start_ms", "end_ms", "index")


STAGE_LIST = ", ".join(f"'{s}'" for s in ("acquire", *ledger.ALL_STAGES))
SQL_RECORDS = f"names AS (SELECT [{STAGE_LIST}] AS s), rec AS (SELECT (event_id // 40)::VARCHAR AS job_id, s[(event_id % 10 + 1)::INTEGER] AS stage, CASE WHEN event_id % 53 = 0 THEN 'blocked' WHEN event_id % 47 = 0 THEN 'running' ELSE 'complete' END AS status, event_id AS completed, event_id FROM events, names WHERE event_id IS NOT NULL)"
SQL_LATEST = "latest AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY event_id DESC) = 1)"


def _records(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").filter("event_id is not null")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("acquire", *ledger.ALL_STAGES)]), (F.col("event_id") % 10 + 1).cast("int"))
    status = F.when(F.col("event_id") % 53 == 0, "blocked").when(F.col("event_id") % 47 == 0, "running").otherwise("complete")
    out = F.array(F.struct(F.lit("out").alias("path"), F.lit(1).cast("bigint").alias("bytes"), F.sha2((F.col("event_id") % 31).cast("string"), 256).alias("sha256")))
    return e.select(F.floor(F.col("event_id") / 40).cast("string").alias("job_id"), stage.alias("stage"), status.alias("status"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("completed_at"), F.col("event_id").alias("recorded_at"), out.alias("outputs"))


@query(f"WITH {SQL_RECORDS}, {SQL_LATEST} SELECT job_id, stage, status, event_id::BIGINT AS recorded_at FROM latest")
def ledger_latest(spark, sf_dir):
    return ledger.latest_state(_records(spark, sf_dir)).select("job_id", "stage", "status", "recorded_at")


@query(f"WITH {SQL_RECORDS}, j AS (SELECT job_id, stage, status FROM rec QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) = 1) SELECT job_id, CASE WHEN status = 'blocked' THEN 'blocked' WHEN status = 'complete' AND stage = 'manifest' THEN 'complete' ELSE 'in_progress' END AS status FROM j")
def job_status(spark, sf_dir):
    return ledger.overall_status(ledger.latest_state(_records(spark, sf_dir)))


@query(
    f"WITH RECURSIVE {SQL_RECORDS}, {SQL_LATEST}, ord AS (SELECT unnest([{STAGE_LIST}]) AS stage, unnest(range(10)) AS k), own AS (SELECT j.job_id, o.k, o.stage, coalesce(l.status = 'complete' AND l.event_id % 31 <> 7, false) AS ok, l.event_id AS e FROM (SELECT DISTINCT job_id FROM rec) j CROSS JOIN ord o LEFT JOIN latest l ON l.job_id = j.job_id AND l.stage = o.stage), "
    "walk AS (SELECT job_id, k, stage, ok, e FROM own WHERE k = 0 UNION ALL SELECT o.job_id, o.k, o.stage, coalesce(o.ok AND w.ok AND w.e <= o.e, false), o.e FROM walk w JOIN own o ON o.job_id = w.job_id AND o.k = w.k + 1) SELECT job_id, stage, ok AS resumable FROM walk"
)
def resume_decision(spark, sf_dir):
    latest = ledger.latest_state(_records(spark, sf_dir))
    # The file of every stage is there, but changed where the record's number leaves 7 of 31.
    present = latest.select("job_id", "stage", F.concat(F.col("stage"), F.lit("/out")).alias("path"), F.when(F.col("recorded_at") % 31 == 7, F.lit("changed")).otherwise(F.col("outputs")[0]["sha256"]).alias("sha256"))
    named = latest.withColumn("outputs", F.transform("outputs", lambda o: o.withField("path", F.concat(F.col("stage"), F.lit("/out")))))
    return ledger.resume_decisions(ledger.own_records_valid(named, present))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents")
def artifact_hash(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), _long(F.octet_length(text)).alias("bytes"))


@query(
    "WITH r AS (SELECT doc_id, text, regexp_replace(text, '(?i)https?://[^\\s\"''<>]+', '[REDACTED_URL]', 'g') AS a FROM documents), z AS (SELECT doc_id, text, regexp_replace(a, '(?i)(authorization\\s*:\\s*)[^\\r\\n]+?(\\s+[A-Za-z-]+\\s*:|$)', '\\1[REDACTED]\\2', 'g') AS a FROM r), s AS (SELECT doc_id, text, regexp_replace(a, '(?i)(cookie\\s*:\\s*)[^\\r\\n]+', '\\1[REDACTED]', 'g') AS b FROM z), "
    "t AS (SELECT doc_id, text, regexp_replace(b, '(?i)\\b(token|signature|sig|key|secret|password|otp)=([^&\\s]+)', '\\1=[REDACTED]', 'g') AS c FROM s) SELECT doc_id, coalesce(c <> text, false) AS changed, md5(coalesce(c, '')) AS digest FROM t"
)
def redaction_scan(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text", redaction.redact_text(F.col("text")).alias("c"))
    return d.select("doc_id", F.coalesce(F.col("c") != F.col("text"), F.lit(False)).alias("changed"), F.md5(F.coalesce("c", F.lit(""))).alias("digest"))


@query(
    "WITH k AS (SELECT page_id, page_id % 6 AS m, ['Signed-URL', 'stage', 'api_key', 'key_api_keys', 'X-Token', 'tokens'][(page_id % 6 + 1)::INTEGER] AS key, url FROM pages WHERE page_id IS NOT NULL) SELECT page_id, CASE WHEN m IN (0, 2, 4) THEN 'sensitive key' ELSE 'sensitive value' END AS reason FROM k WHERE m IN (0, 2, 4) OR regexp_matches(url, '(?i)https?://[^\\s]+')"
)
def sensitive_fields(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Signed-URL", "stage", "api_key", "key_api_keys", "X-Token", "tokens")])
    p = views.table(spark, sf_dir, "pages").filter("page_id is not null").select("page_id", F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")).alias("key"), F.col("url").alias("value"))
    return redaction.refused_fields(p).select("page_id", "reason")


@query(f"WITH {SQL_RECORDS}, bad AS (SELECT job_id, bool_and(status = 'complete') AS fine, count(DISTINCT stage)::BIGINT AS n FROM rec GROUP BY job_id) SELECT job_id, CASE WHEN NOT fine THEN 'QUALITY_NOT_PASSING' WHEN n < 10 THEN 'COMPLETION_ARTIFACT_MISSING' END AS code, CASE WHEN fine AND n = 10 THEN n END AS artifacts FROM bad")
def manifest(spark, sf_dir):
    rec = _records(spark, sf_dir)
    required = rec.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(s) for s in ("acquire", *ledger.ALL_STAGES)])).alias("path"))
    present = rec.groupBy("job_id", F.col("stage").alias("path")).agg(F.lit(1).cast("bigint").alias("bytes"), F.max(F.col("outputs")[0]["sha256"]).alias("sha256"))
    reports = rec.select("job_id", F.col("stage").alias("report"), F.when(F.col("status") == "complete", "PASS").otherwise("BLOCKED").alias("status"))
    made = ledger.manifest(required, present, reports)
    return made.select("job_id", "code", _long(F.when(F.col("artifacts").isNotNull(), F.size("artifacts"))).alias("artifacts"))


@query("SELECT event_type AS stage, count(*)::BIGINT AS events, count(*) FILTER (WHERE value < 10)::BIGINT AS low FROM events GROUP BY event_type")
def event_summary(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("events"), F.count_if(F.col("value") < 10).alias("low"))


@query("SELECT event_type AS stage, epoch_us(date_trunc('hour', ts))::BIGINT AS start_us, count(*)::BIGINT AS events, count(*) FILTER (WHERE value < 10)::BIGINT AS blocked FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    """Events as a stream into tumbling windows; low values stand for blocked stages."""
    schema = views.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = e.select(F.col("event_type").alias("stage"), F.when(F.col("value") < 10, "blocked").otherwise("complete").alias("status"), F.col("ts").cast("timestamp").alias("at")).filter("at is not null")
    made = event_stream.run_to_end(event_stream.blocked_rates(e))
    return made.select("stage", F.unix_micros("start").alias("start_us"), "events", "blocked")


@query(
    f"WITH {SQL_SEGMENTS}, folded AS (SELECT job_id, seq, array_to_string({TOKENS.format('text')}, '') AS y FROM seg), pairs AS (SELECT job_id, seq, lag(y) OVER (PARTITION BY job_id ORDER BY seq) AS x, y FROM folded), "
    "beyond AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS far FROM (SELECT DISTINCT unnest(string_split(y, '')) AS c FROM folded) WHERE strlen(c) > 1), pool AS (SELECT far, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~', 1, length(far)) AS near FROM beyond) "
    "SELECT job_id, seq, levenshtein(translate(x, far, near), translate(y, far, near))::BIGINT AS distance FROM pairs, pool WHERE x IS NOT NULL"
)
def consecutive_turns_cer(spark, sf_dir):
    """Character distance of consecutive turns of a conversation, folded: a check on many short pairs."""
    segs = views.segments(spark, sf_dir).select("job_id", "seq", F.array_join(tokens(F.col("text")), "").alias("t"))
    before = F.lag("t").over(Window.partitionBy("job_id").orderBy("seq"))
    pairs = segs.withColumn("p", before).filter("p is not null")
    return pairs.select("job_id", "seq", _long(char_distance(F.col("p"), F.col("t"))).alias("distance"))


@query(f"WITH {SQL_SEGMENTS}, {SQL_CUES} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1)::INTEGER AS seq, 'native-' || row_number() OVER (PARTITION BY job_id ORDER BY seq) AS id, start_ms / 1000.0::DOUBLE AS \"start\", end_ms / 1000.0::DOUBLE AS \"end\", trim(text) AS text, 'native_caption' AS source FROM cue WHERE trim(text) <> ''")
def native_segments(spark, sf_dir):
    """Caption files of each job, every other one SRT, read as transcripts."""
    said = _said(views.segments(spark, sf_dir))
    even = F.col("job_id").cast("long") % 2 == 0
    files = captions.render_vtt(said.filter(even), ["job_id"]).withColumn("path", F.lit("source/native.pt-BR.VTT")).union(captions.render_srt(said.filter(~even), ["job_id"]).withColumn("path", F.lit("source/native.srt")))
    return rereads.native_segments(files, ["job_id"]).select("job_id", F.col("seq").cast("int").alias("seq"), "id", "start", "end", "text", "source")


SQL_ATTEMPTS = "att AS (SELECT job_id, candidate, CASE WHEN (d + length(candidate)) % 7 = 0 THEN 'unavailable' WHEN (d + ascii(candidate)) % 5 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM evals)"


def _attempts(spark, sf_dir):
    d = _simple(spark, sf_dir).select("job_id", "candidate", F.col("job_id").cast("long").alias("d"))
    outcome = F.when((F.col("d") + F.length("candidate")) % 7 == 0, "unavailable").when((F.col("d") + F.ascii("candidate")) % 5 == 0, "failed").otherwise("ok")
    return d.select("job_id", "candidate", outcome.alias("outcome"))


@query(f"WITH {SQL_GATED}, {SQL_ATTEMPTS} SELECT job_id, candidate, CASE outcome WHEN 'unavailable' THEN 'excluded' WHEN 'failed' THEN 'failed' ELSE CASE WHEN failed_gates = '' THEN 'eligible' ELSE 'rejected' END END AS status FROM att JOIN gd USING (job_id, candidate)")
def bake_off_status(spark, sf_dir):
    return rereads.bake_off_status(metrics.gated(_simple(spark, sf_dir)), _attempts(spark, sf_dir))


@query(
    f"WITH {SQL_GATED}, {SQL_ATTEMPTS}, ok AS (SELECT gd.* FROM gd JOIN att USING (job_id, candidate) WHERE outcome = 'ok'), n AS (SELECT job_id, count(*) FILTER (WHERE outcome = 'ok') AS n FROM att GROUP BY job_id), "
    "w AS (SELECT job_id, candidate FROM ok WHERE failed_gates = '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY wer, candidate <> 'native', score, candidate) = 1) "
    "SELECT job_id, CASE WHEN n >= 2 THEN w.candidate END AS selected, CASE WHEN n < 2 THEN 'ASR_CANDIDATES_INSUFFICIENT' WHEN w.candidate IS NULL THEN 'ASR_QUALITY_GATES_FAILED' END AS code FROM n LEFT JOIN w USING (job_id)"
)
def bake_off(spark, sf_dir):
    return rereads.bake_off(metrics.gated(_simple(spark, sf_dir)), _attempts(spark, sf_dir))


def _artifacts(spark, sf_dir):
    """Artifacts of a job for each document, some of them missing, broken or empty."""
    d = views.table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.col("doc_id").cast("string").alias("job_id"))
    pick = lambda m, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("d") % m % len(texts) + 1).cast("int"))
    row = lambda path, content: d.select("job_id", F.lit(path).alias("path"), content.alias("content"))
    segment = '{"id": "a", "start": 0, "end": 1, "text": "t"}'
    files = [
        row(rereads.CLIPS, pick(3, '{"clips": [{"ordinal": 1, "path": "p", "start": 0.5}]}', '{"clips": []}', "no json")), row(rereads.TRANSLATION, pick(5, f'{{"segments": [{segment}]}}', None, '{"segments": [{"id": "a"}]}', "no json", '{"segments": []}')),
        row(rereads.SUBTITLES, pick(4, "1\n00:00:00,000 --> 00:00:01,000\nt\n", None, "", "no cue")), row("validation/transcript.json", pick(3, '{"status": "PASS"}', '{"status": "BLOCKED"}', "no json")), row(rereads.SOFT_OUTPUTS[0], pick(2, "x", None)), row(rereads.SOFT_OUTPUTS[1], pick(6, None, "x", None, None, "x", None)),
    ]
    out = files[0]
    for f in files[1:]:
        out = out.union(f)
    return d.select("job_id"), out.filter("content is not null")


@query(
    "WITH d AS (SELECT doc_id AS d, doc_id::VARCHAR AS job_id FROM documents WHERE doc_id IS NOT NULL) SELECT job_id, CASE d % 3 WHEN 1 THEN 'EVAL_CLIPS_MISSING' WHEN 2 THEN 'ARTIFACT_INVALID' END AS clips, CASE d % 5 WHEN 1 THEN 'TRANSLATION_MISSING' WHEN 2 THEN 'TRANSLATION_INVALID' WHEN 3 THEN 'ARTIFACT_INVALID' END AS translation, "
    "CASE d % 4 WHEN 1 THEN 'SUBTITLES_MISSING' WHEN 2 THEN 'SUBTITLES_EMPTY' WHEN 3 THEN 'SUBTITLES_EMPTY' END AS subtitles, CASE d % 3 WHEN 1 THEN 'TRANSCRIPT_NOT_PASSING' WHEN 2 THEN 'ARTIFACT_INVALID' END AS transcript, CASE WHEN (d % 2 = 0)::INT + (d % 6 IN (1, 4))::INT <> 1 THEN 'SOFT_OUTPUT_MISSING' END AS soft FROM d"
)
def reread_codes(spark, sf_dir):
    jobs, files = _artifacts(spark, sf_dir)
    out = rereads.clip_records(jobs, files)[1].withColumnRenamed("code", "clips")
    parts = {"translation": rereads.translations(jobs, files)[1], "subtitles": rereads.cues(jobs, files)[1], "transcript": rereads.passing(jobs, files, "validation/transcript.json", "TRANSCRIPT_NOT_PASSING"), "soft": rereads.soft_outputs(jobs, files)}
    for name, coded in parts.items():
        out = out.join(coded.select("job_id", F.col("code").alias(name)), "job_id")
    return out


from captionloom.plans import stage_queries  # noqa: E402, F401  (registers its queries)
