import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from captionloom.operators import transcripts, translation


def payload(spark, value):
    return spark.createDataFrame([("j", json.dumps(value))], "job_id string, payload string")


def test_utterances(spark):
    words = [{"word": "ola", "punctuated_word": "Olá,", "start": 0.0, "end": 0.5, "confidence": 0.91}, {"word": "mundo", "start": 0.5, "end": 1.0, "confidence": 0.42}]
    u = {"start": 0.0, "end": 1.0, "confidence": 0.72, "transcript": " Olá, mundo ", "words": words}
    row = transcripts.parse_utterances(payload(spark, {"results": {"utterances": [u]}}), 0.65).first()
    assert (row.id, row.text, row.uncertainty, [w.text for w in row.words]) == ("dg-1", "Olá, mundo", ["low_word_confidence"], ["Olá,", "mundo"])
    one = transcripts.parse_utterances(payload(spark, {"results": {"channels": [{"alternatives": [{"transcript": "oi", "confidence": 0.1, "words": words}]}]}}), 0.65).first()
    assert (one.id, one.start, one.end, one.uncertainty) == ("dg-1", 0.0, 1.0, [])
    with pytest.raises(PySparkException, match="non-finite"):
        transcripts.parse_utterances(payload(spark, {"results": {"utterances": [u | {"confidence": float("inf")}]}}), 0.65).collect()


def test_scored_segments(spark):
    s = {"id": 0, "start": 0.0, "end": 1.0, "text": " oi ", "avg_logprob": -1.2, "compression_ratio": 2.5, "no_speech_prob": 0.7}
    row = transcripts.parse_scored_segments(payload(spark, {"segments": [s]})).first()
    assert (row.id, row.text, row.confidence, row.uncertainty) == ("ow-1", "oi", pytest.approx(0.301194, abs=1e-6), ["low_log_probability", "high_compression_ratio", "possible_silence"])
    alone = transcripts.parse_scored_segments(payload(spark, {"text": " só texto ", "duration": 3.0, "segments": []})).first()
    assert (alone.text, alone.end, alone.uncertainty) == ("só texto", 3.0, ["missing_segment_timestamps"])
    with pytest.raises(PySparkException, match="non-finite"):
        transcripts.parse_scored_segments(payload(spark, {"segments": [s | {"avg_logprob": float("nan")}]})).collect()


def test_reference_decoding(spark):
    good = {"language": "pt-BR", "manually_reviewed": True, "reviewed_by": "R", "glossary_terms": ["Ana"], "numbers": ["42"], "segments": [{"id": "a", "start": 0, "end": 2, "text": " Oi. "}], "reviewed_at": "x"}
    rows = [("ok", good), ("unreviewed", good | {"manually_reviewed": False}), ("nobody", good | {"reviewed_by": " "}), ("silent", good | {"segments": [{"id": "a", "start": 0, "end": 1, "text": " "}]}), ("null", good | {"segments": [{"id": "a", "start": 0, "end": 1, "text": None}]})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [("junk", "[")], "job_id string, payload string")
    read = transcripts.decode_transcripts(df)
    assert {r.job_id: r.code for r in transcripts.reference_status(read).collect()} == {"ok": None, "unreviewed": "MANUAL_REFERENCE_UNVERIFIED", "nobody": "MANUAL_REFERENCE_UNVERIFIED", "silent": "MANUAL_REFERENCE_EMPTY", "null": "MANUAL_REFERENCE_INVALID", "junk": "MANUAL_REFERENCE_INVALID"}
    row = transcripts.segment_rows(read.filter("job_id = 'ok'")).first()
    assert (row.seq, row.text, row.words) == (0, "Oi.", []) and read.filter("job_id = 'ok'").first().provider == "manual"


def test_plans(spark):
    media = spark.createDataFrame([("j", 12.0)], "job_id string, duration double")
    assert [(r.ordinal, r.start) for r in transcripts.clip_plan(media, [0.1, 0.5, 0.9], 2.0).orderBy("ordinal").collect()] == [(1, 0.2), (2, 5.0), (3, 9.8)]
    assert [(r.part, r.offset, r.length) for r in transcripts.chunk_plan(media, 5).orderBy("part").collect()] == [(0, 0.0, 5.0), (1, 5.0, 5.0), (2, 10.0, 2.0)]


WORDS = "array<struct<text: string, start: double, end: double, confidence: double>>"
SEGMENT = f"job_id string, seq int, id string, start double, end double, text string, confidence double, uncertainty array<string>, words {WORDS}"


def test_transcript_rules(spark):
    nan = float("nan")
    rows = [(0.0, 1.0, "a", 0.9, []), (0.5, 9.0, "b", 1.5, []), (0.4, 0.9, " ", 0.1, []), (nan, 1.0, "d", None, []), (-1.0, 1.0, "e", nan, [("", 0.0, 1.0, 2.0), ("x", 1.0, 0.5, None)]), (0.2, 0.3, "f", None, [])]
    s = spark.createDataFrame([("j", k, "same" if k in (0, 5) else f"s{k}", a, b, t, c, [], w) for k, (a, b, t, c, w) in enumerate(rows)], SEGMENT)
    media = spark.createDataFrame([("j", 10.0)], "job_id string, duration double")
    got = {}
    for r in transcripts.validate_segments(s, media, F.lit("en")).collect():
        got.setdefault(r.seq, []).append(r.rule)
    assert got == {
        0: ["language mismatch"], 1: ["invalid confidence"], 2: ["empty text", "out-of-order timing"], 3: ["non-finite timing"],
        4: ["invalid media bounds", "invalid confidence", "invalid word timing", "empty word", "invalid word confidence"], 5: ["duplicate identifier", "out-of-order timing"],
    }
    flagged = {r.seq: r.uncertainty for r in transcripts.flag_low_confidence(s, 0.65).collect()}
    assert flagged[2] == ["low_segment_confidence"] and flagged[1] == flagged[4] == []


def pair(spark, source, target, flags=(), kept=(), start=0.0, source_text=None):
    a = spark.createDataFrame([("j", 0, "x", 0.0, 1.0, source, None, list(flags), [])], SEGMENT)
    b = spark.createDataFrame([("j", 0, "x", start, 1.0, source_text or source, target, list(kept), "")], "job_id string, seq int, id string, start double, end double, source_text string, text string, uncertainty array<string>, notes string")
    return a, b


@pytest.mark.parametrize(
    ("given", "terms", "want"),
    [
        ({"source": "Ana processou 42 exemplos.", "target": "She processed examples."}, ["Ana"], ["missing number 42", "missing glossary term Ana"]),
        ({"source": "Exemplo incerto.", "target": "Uncertain example 99.", "flags": ["low_segment_confidence"]}, [], ["source uncertainty was dropped", "unexpected number 99"]),
        ({"source": "O total é 1.500,50.", "target": "The total is 1,500.50."}, [], []),
        ({"source": "a", "target": "b", "start": 0.0009}, [], []),
        ({"source": "a", "target": "b", "start": 0.0011}, [], ["timing changed"]),
        ({"source": "a", "target": "b", "start": float("nan"), "source_text": "c"}, [], ["non-finite timing", "source text changed"]),
        ({"source": "1,2,3", "target": " "}, [], ["empty translation", "malformed number 1,2,3"]),
    ],
)
def test_translation_rules(spark, given, terms, want):
    a, b = pair(spark, **given)
    assert [r.rule for r in translation.validate_translation(a, b, terms).collect()] == want


def test_translation_ids(spark):
    a, b = pair(spark, "a", "b")
    twice = translation.validate_translation(a, b.union(b), []).collect()
    assert [(r.seq, r.rule) for r in twice if r.seq is None] == [(None, "duplicate segment identifiers")]
    assert [r.rule for r in translation.validate_translation(a, b.withColumn("id", F.lit("y")), []).collect()] == ["translation coverage is incomplete"]
    assert translation.coverage(a, b.filter("false")).first().coverage == 0


def test_results_follow_the_source(spark):
    rows = [("j", k, f"s{k}", float(k), k + 1.0, f"t{k}", None, ["f"], []) for k in range(3)]
    source = spark.createDataFrame(rows, SEGMENT)
    good = payload(spark, {"translations": [{"id": f"s{k}", "text": f" T{k} ", "uncertain": k == 1, "notes": ""} for k in (2, 0, 1)]})
    made = translation.decode_results(good, source).orderBy("seq").collect()
    assert [(r.id, r.text, r.uncertainty, r.code) for r in made] == [("s0", "T0", ["f"], None), ("s1", "T1", ["f", "translation_uncertain"], None), ("s2", "T2", ["f"], None)]
    short = payload(spark, {"translations": [{"id": "s0", "text": "x", "uncertain": False, "notes": ""}]})
    assert {r.code for r in translation.decode_results(short, source).collect()} == {"PROVIDER_FAILURE"}
    assert json.loads(translation.prompts(translation.batches(source, 2)).orderBy("batch").first().payload)[1]["id"] == "s1"
