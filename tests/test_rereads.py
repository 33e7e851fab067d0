"""Artifacts read back: rows where they are whole, a stable code where not."""

import json

from captionloom.plans import rereads


def test_rows_and_codes(spark):
    segment = {"id": "a", "start": 0.0, "end": 1.0, "text": "t", "uncertainty": ["x"]}
    files = spark.createDataFrame(
        [("a", rereads.TRANSLATION, json.dumps({"segments": [segment]})), ("b", rereads.TRANSLATION, json.dumps({"segments": [{"id": "b"}]})), ("a", rereads.CLIPS, json.dumps({"clips": [{"ordinal": 1, "path": "p", "start": 0.5, "duration": 2.0}]})), ("b", rereads.CLIPS, "[]"),
         ("a", rereads.SUBTITLES, "1\n00:00:00,000 --> 00:00:01,000\nt\n"), ("b", rereads.SUBTITLES, ""), ("a", rereads.REFERENCE, json.dumps({"glossary_terms": ["Ana", "x"]})), ("a", rereads.SOFT_OUTPUTS[1], None), ("b", rereads.SOFT_OUTPUTS[0], None), ("b", rereads.SOFT_OUTPUTS[1], None), ("a", "r.json", '{"status": "PASS"}')],
        "job_id string, path string, content string",
    )
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    codes = lambda df: {r.job_id: r.code for r in df.collect()}
    rows, code = rereads.translations(jobs, files)
    assert [tuple(r) for r in rows.collect()] == [("a", 0, "a", 0.0, 1.0, "", "t", ["x"], "")] and codes(code) == {"a": None, "b": "TRANSLATION_INVALID", "c": "TRANSLATION_MISSING"}
    rows, code = rereads.clip_records(jobs, files)
    assert [tuple(r)[:4] for r in rows.collect()] == [("a", 1, "p", 0.5)] and codes(code) == {"a": None, "b": "ARTIFACT_INVALID", "c": "ARTIFACT_INVALID"}
    rows, code = rereads.cues(jobs, files)
    assert rows.count() == 1 and codes(code) == {"a": None, "b": "SUBTITLES_EMPTY", "c": "SUBTITLES_MISSING"}
    assert {(r.job_id, r.term) for r in rereads.glossary_terms(jobs, files).collect()} == {("a", "Ana"), ("a", "x")}
    assert {r.job_id: (r.path, r.code) for r in rereads.soft_outputs(jobs, files).collect()} == {"a": (rereads.SOFT_OUTPUTS[1], None), "b": (None, "SOFT_OUTPUT_MISSING"), "c": (None, "SOFT_OUTPUT_MISSING")}
    assert codes(rereads.passing(jobs, files, "r.json", "NOT_PASSING")) == {"a": None, "b": "ARTIFACT_INVALID", "c": "ARTIFACT_INVALID"}


def test_native_captions_are_segments(spark):
    vtt = "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nOi\n\nNOTE x\n\n00:00:02.000 --> 00:00:03.000 align:start\n  \n"
    srt = "7\n00:00:00,000 --> 00:00:01,000\nOla\nmundo\n"
    files = spark.createDataFrame([("a", "n.VTT", vtt), ("b", "n.srt", srt), ("c", "n.srt", None)], "job_id string, path string, content string")
    got = sorted((r.job_id, r.id, r.start, r.end, r.text, r.source, r.words) for r in rereads.native_segments(files, ["job_id"]).collect())
    assert got == [("a", "native-1", 0.0, 1.5, "Oi", "native_caption", []), ("b", "native-7", 0.0, 1.0, "Ola\nmundo", "native_caption", [])]
