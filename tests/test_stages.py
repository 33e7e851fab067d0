"""Stages for many jobs: one job's failure is a row, the others go on; evidence and the manifest's contract by hand."""

import json

import numpy as np
import pytest

from captionloom.operators import evidence
from captionloom.plans import ledger, stages
from captionloom.plans.engine import NO_RESULT, Engine, ProviderError, StageBlocked
from captionloom.sources.media import lower_difference

OUT = "job_id string, path string, bytes bigint, sha256 string, code string"


def test_one_jobs_failure_leaves_the_others(spark, tmp_path):
    seen = []

    def stage(name, bad, silent=()):
        def run(s, jobs):
            mine = sorted(r.job_id for r in jobs.collect())
            seen.append((name, "".join(mine)))
            rows = [(j, f"out/{name}", 1, "h", None) for j in mine if j not in silent and j not in bad] + [(j, "partly", 1, "h", None) for j in bad if j in mine] + [(j, None, None, None, bad[j]) for j in bad if j in mine]
            return s.createDataFrame(rows, OUT)

        return run

    jobs = spark.createDataFrame([(j,) for j in "abcd"], "job_id string")
    e = Engine(spark, str(tmp_path), {"normalize": stage("normalize", {"b": "SOURCE_MISSING"}), "transcribe": stage("transcribe", {}, silent=("c",)), "translate": stage("translate", {})}, jobs=jobs)
    assert e.run(["normalize", "transcribe", "translate"]) == ["normalize", "transcribe", "translate"]
    assert seen == [("normalize", "abcd"), ("transcribe", "acd"), ("translate", "ad")]
    last = {(r.job_id, r.stage): (r.status, r.code) for r in ledger.latest_state(e.records()).collect()}
    assert last["b", "normalize"] == ("blocked", "SOURCE_MISSING") and last["c", "transcribe"] == ("blocked", NO_RESULT) and last["a", "translate"] == ("complete", None)
    assert ("b", "transcribe") not in last and ("c", "translate") not in last and not any(s == "running" for s, _ in last.values())
    assert {r.job_id: r.status for r in e.status().collect()} == {"a": "in_progress", "b": "blocked", "c": "blocked", "d": "in_progress"}


def test_no_job_left_raises_and_resuming_tries_again(spark, tmp_path):
    down = [True]

    def transcribe(s, jobs):
        rows = [(r.job_id, None, None, None, "PROVIDER_UNAVAILABLE") if down[0] else (r.job_id, "t", 1, "h", None) for r in jobs.collect()]
        return s.createDataFrame(rows, OUT)

    done = lambda s, jobs: jobs.selectExpr("job_id", "'n' AS path", "1L AS bytes", "'h' AS sha256")
    present = lambda s: s.createDataFrame([(j, p, "h") for j in "ab" for p in "ntv"], "job_id string, path string, sha256 string")
    e = Engine(spark, str(tmp_path), {"normalize": done, "transcribe": transcribe}, jobs=spark.createDataFrame([("a",), ("b",)], "job_id string"), present=present)
    e.acquired(spark.createDataFrame([(j, "v", 1, "h") for j in "ab"], "job_id string, path string, bytes bigint, sha256 string"))
    with pytest.raises(StageBlocked) as caught:
        e.run(["normalize", "transcribe"], resume=True)
    assert caught.value.code == "PROVIDER_UNAVAILABLE"
    down[0] = False
    assert e.run(["normalize", "transcribe"], resume=True) == ["transcribe"]
    assert e.run(["normalize", "transcribe"], resume=True) == []


def test_a_record_without_a_known_context_is_refused(spark):
    state = "job_id string, stage string, status string, completed_at string, context_sha256 string, outputs array<struct<path: string, bytes: bigint, sha256: string>>, recorded_at bigint"
    latest = ledger.latest_state(spark.createDataFrame([("j", s, "complete", "1", "c", [("f", 1, "h")], 1) for s in ("acquire", "normalize", "transcribe")], state))
    present = spark.createDataFrame([("j", "f", "h")], "job_id string, path string, sha256 string")
    contexts = spark.createDataFrame([("j", "normalize", "c")], "job_id string, stage string, context_sha256 string")
    valid = lambda every: {r.stage: r.valid for r in ledger.own_records_valid(latest, present, contexts, every).collect()}
    assert valid(True) == {"acquire": True, "normalize": True, "transcribe": False} and all(valid(False).values())


def test_responses_that_are_none_block_their_job_alone(spark):
    answers = {"good": json.dumps({"segments": [{"id": 0, "start": 0, "end": 1, "text": "t"}]}), "none": None, "list": "[]", "nan": '{"segments": [{"start": NaN}]}', "word": '{"segments": [{"start": "x"}]}', "huge": '{"segments": [{"start": 1e999}]}', "flat": '{"segments": ["x"]}'}

    def provider(path, **_):
        if path == "raises":
            raise ProviderError("no")
        if path == "breaks":
            raise ZeroDivisionError
        return answers[path]

    chunks = spark.createDataFrame([(k, 0, 0.0, k) for k in [*answers, "raises", "breaks"]], "job_id string, part int, offset double, path string")
    got = {r.job_id: r.code for r in stages.asked(chunks, provider, 0.5).collect()}
    assert got == dict.fromkeys(answers, "PROVIDER_FAILURE") | {"good": None, "raises": "PROVIDER_FAILURE", "breaks": "INTERNAL_FAILURE"}


def test_artifacts_are_the_newest_and_may_be_taken_away(spark, tmp_path):
    kept = stages.Artifacts(spark, str(tmp_path / "a"))
    rows = lambda *r: spark.createDataFrame(list(r), "job_id string, path string, content string")
    assert kept.files().count() == 0
    kept.add(rows(("a", "p", "1"), ("a", "q", "1")), 1)
    kept.add(rows(("a", "p", "2"), ("a", "q", None)), 2)
    kept.add(rows(("a", "p", "2"), ("a", "q", None)), 2)  # a replay
    assert [tuple(r) for r in kept.files().collect()] == [("a", "p", "2")]


def frames(spark, rows):
    return spark.createDataFrame([(j, k, w, h, bytearray(p) if p is not None else None) for j, k, w, h, p in rows], "job_id string, ordinal int, width int, height int, pixels binary")


def test_frame_gate(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (8, 5, 3), np.uint8)
    b = a.copy()
    b[5:] = 255 - b[5:]
    raw = a.tobytes()
    source = [(j, k, 5, 8, raw) for j in ("good", "same", "size", "short") for k in (0, 1)] + [("lost", 0, 5, 8, raw), ("lost", 1, 5, 8, raw), ("empty", 0, 5, 8, raw), ("twice", 0, 5, 8, raw), ("twice", 0, 5, 8, raw), ("flat", 0, 0, 0, b"x")]
    burned = [("good", k, 5, 8, b.tobytes()) for k in (0, 1)] + [("same", 0, 5, 8, b.tobytes()), ("same", 1, 5, 8, raw)] + [("size", k, 8, 5, b.tobytes()) for k in (0, 1)] + [("short", k, 5, 8, b.tobytes()[:-1]) for k in (0, 1)]
    burned += [("lost", 0, 5, 8, b.tobytes()), ("empty", 0, 5, 8, None), ("twice", 0, 5, 8, b.tobytes()), ("twice", 1, 5, 8, b.tobytes()), ("other", 0, 5, 8, raw), ("flat", 0, 0, 0, b"x")]
    s, c = frames(spark, source), frames(spark, burned)
    got = {(x.job_id, x.ordinal): x.ratio for x in evidence.compare_frames(s, c).filter("job_id = 'good'").collect()}
    assert got["good", 0] == pytest.approx(lower_difference(a, b)) and 0 < got["good", 0] < 1
    jobs = spark.createDataFrame([(j,) for j in ("good", "same", "size", "short", "lost", "empty", "twice", "nothing", "flat")], "job_id string")
    rules = {}
    for x in evidence.frame_gate(jobs, s, c).collect():
        rules.setdefault(x.job_id, set()).add(x.rule[:14])
    sampling, comparing, overlay = "cue frame samp", "sampled frame ", "burned cue fra"
    assert rules == {"same": {overlay}, "size": {comparing, overlay}, "short": {comparing, overlay}, "lost": {sampling, overlay}, "empty": {sampling, overlay}, "twice": {sampling, overlay}, "nothing": {sampling, overlay}, "flat": {comparing, overlay}}
    assert evidence.frame_gate(jobs.limit(0), s, c).count() == 0


def test_manifest_contract_by_hand(spark):
    named = [*evidence.REQUIRED, *evidence.PASSING, "source/source.mp4", "output/soft-subtitled.mkv", "f/1", "s/1"]
    report = {"quality_status": "PASS", "sampled_frames": [{"path": "f/1", "sha256": "h"}], "source_sampled_frames": [{"path": "s/1", "sha256": "h"}], "burned_lower_frame_difference_ratio": [0.5]}
    cases = {
        "good": {}, "empty": {"sampled_frames": [], "burned_lower_frame_difference_ratio": []}, "nan": {"burned_lower_frame_difference_ratio": [float("nan")]}, "huge": {"burned_lower_frame_difference_ratio": ["Infinity"]}, "text": {"burned_lower_frame_difference_ratio": ["x"]}, "textual": {"burned_lower_frame_difference_ratio": ["0.5"]}, "low": {"burned_lower_frame_difference_ratio": [0.001]},
        "long": {"burned_lower_frame_difference_ratio": [0.5, 0.5]}, "null": {"burned_lower_frame_difference_ratio": None}, "string": {"sampled_frames": ["f/1"]}, "changed": {"sampled_frames": [{"path": "f/1", "sha256": "x"}]}, "gone": {"source_sampled_frames": [{"path": "s/2", "sha256": "h"}]}, "number": {"sampled_frames": 5}, "blocked": {"quality_status": "BLOCKED"},
    }
    reports = [(j, "validation/report.json", json.dumps(report | c)) for j, c in cases.items()] + [(j, p, '{"status": "PASS"}') for j in cases for p in evidence.PASSING]
    files = [(j, p, "h") for j in cases for p in named]
    frame = lambda rows, *c: spark.createDataFrame(rows, ", ".join(f"{x} string" for x in c))
    jobs = frame([(j,) for j in cases], "job_id")
    got = {}
    for r in evidence.manifest_contract(jobs, frame(files, "job_id", "path", "sha256"), frame(reports, "job_id", "path", "content")).collect():
        got.setdefault(r.job_id, []).append((r.code, r.rule))
    bad = "VALIDATION_EVIDENCE_INVALID"
    assert {j: sorted(v) for j, v in got.items()} == {
        "empty": [(bad, "no frames"), (bad, "not as many as frames")], "nan": [(bad, "no number")], "huge": [(bad, "not finite")], "text": [(bad, "no number")], "low": [(bad, "below minimum")], "long": [(bad, "not as many as frames")], "null": [(bad, "not as many as frames")], "string": [(bad, "no record")],
        "changed": [(bad, "file changed")], "gone": [(bad, "file missing")], "number": [(bad, "no frames"), (bad, "not as many as frames")], "blocked": [("QUALITY_NOT_PASSING", "not passing")],
    }
    fewer = frame([f for f in files if f[1] != "source/source.mp4"] + [("good", "output/soft-subtitled.mp4", "h"), ("good", "source/source/x", "h")], "job_id", "path", "sha256")
    assert sorted((r.field, r.rule) for r in evidence.manifest_contract(jobs.filter("job_id = 'good'"), fewer, frame(reports, "job_id", "path", "content")).collect()) == [("output/soft-subtitled.*", "more than one"), ("source/source.*", "missing")]


def test_providers_are_asked_once_for_each_chunk(spark, tmp_path):
    """From the receipt to checked subtitles of two jobs; each call leaves a file behind."""
    import uuid

    calls = tmp_path / "calls"
    calls.mkdir()

    def recogniser(path, **_):
        (calls / f"heard-{uuid.uuid4()}").touch()
        return json.dumps({"segments": [{"start": 0.5, "end": 3.0, "text": "Ana viu tudo."}, {"start": 4.0, "end": 7.0, "text": "Foi assim."}]})

    def translator(segments, **_):
        (calls / f"said-{uuid.uuid4()}").touch()
        return [{"id": s["id"], "text": s["text"]} for s in segments]

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    media = frame([(j, "source/source.mp4", 5, "h", False) for j in "ab"], "job_id string, path string, bytes long, sha256 string, writable boolean")
    probes = frame([(j, json.dumps({"format": {"duration": "9"}, "streams": []})) for j in "ab"], "job_id string, probe string")
    rendered = frame([], "job_id string, path string, bytes long, sha256 string, duration double, streams array<struct<codec_type: string, codec_name: string, language: string>>")
    frames_ = frame([], "job_id string, side string, ordinal int, path string, sha256 string, width int, height int, pixels binary")
    work = stages.JobStages(media, probes, rendered, frames_, recogniser, translator)
    kept = stages.Artifacts(spark, str(tmp_path / "artifacts"))
    receipt = json.dumps({"status": "PASS", "transport": "local", "source_path": "source/source.mp4", "bytes": 5, "sha256": "h"})
    kept.add(frame([(j, stages.RECEIPT, receipt) for j in "ab"], "job_id string, path string, content string"), 0)
    engine = Engine(spark, str(tmp_path / "ledger"), work.stages(kept), jobs=frame([("a",), ("b",)], "job_id string"), present=kept.present)
    assert engine.run(["normalize", "transcribe", "translate", "subtitles"]) == ["normalize", "transcribe", "translate", "subtitles"]
    assert len(list(calls.glob("heard-*"))) == 2 and len(list(calls.glob("said-*"))) == 2
    srt = {r.job_id: r.content for r in kept.files().filter("path = 'subtitles/en.srt'").collect()}
    assert srt["a"] == srt["b"] == "1\n00:00:00,500 --> 00:00:03,000\nAna viu tudo.\n\n2\n00:00:04,000 --> 00:00:07,000\nFoi assim.\n"
    with pytest.raises(StageBlocked) as caught:
        engine.run(["render"])
    assert caught.value.code == "MEDIA_FAILURE"


def test_state_lines_that_are_no_records(spark, tmp_path):
    good = {"job_id": "j", "stage": "translate", "status": "complete", "recorded_at": "2026-01-01T00:00:00+00:00", "outputs": [{"path": "p", "bytes": 0, "sha256": "h"}], "more": [1]}
    cases = [
        (good, None), ({**good, "outputs": None}, None), ({**good, "outputs": []}, None), ("", "not a record"), (None, "not a record"), ("{", "not a record"), ([good], "not a record"), ({}, "not a record"), ({**good, "outputs": "x"}, "not a record"), ({**good, "job_id": None}, "no job"), ({**good, "job_id": " "}, "no job"),
        ({**good, "stage": "other"}, "unknown stage"), ({**good, "status": "done"}, "unknown status"), ({**good, "recorded_at": "soon"}, "no time"), ({**good, "status": "blocked"}, "no code"), ({**good, "status": "blocked", "code": "X"}, None), ({**good, "outputs": [{"path": "", "bytes": 1, "sha256": "h"}]}, "output incomplete"), ({**good, "outputs": [None]}, "output incomplete"),
    ]
    lines = spark.createDataFrame([(k, c if c is None or isinstance(c, str) else json.dumps(c)) for k, (c, _) in enumerate(cases)], "k int, value string")
    assert [r.rule for r in ledger.decode_states(lines, carry=("k",)).orderBy("k").collect()] == [w for _, w in cases]
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "a.json").write_text("\n".join(r.value for r in lines.collect() if r.value))
    engine = Engine(spark, str(tmp_path), {})
    assert engine.records().count() == 4 and {r.rule: r.n for r in engine.invalid().collect()}["no job"] == 2
    assert engine.status().count() == 1
