import json
import os

import pytest
from pyspark.sql import functions as F

from captionloom.functions import redaction
from captionloom.plans import ledger
from captionloom.plans.config import ConfigError, load_config
from captionloom.plans.engine import Engine, ProviderError, StageBlocked, plan
from captionloom.sources import providers
from captionloom.sources.artifacts import SensitiveDataError, Workspace, file_hashes, sha256_file
from captionloom.streaming import events

STATE = "job_id string, stage string, status string, completed_at string, context_sha256 string, outputs array<struct<path: string, bytes: bigint, sha256: string>>, recorded_at bigint"


def test_resume(spark):
    rows = [("j", s, "complete", f"{k:02}", "c", [(s, 1, "h")], k) for k, s in enumerate(["acquire", *ledger.ALL_STAGES])]
    present = spark.createDataFrame([("j", r[1], "h") for r in rows], "job_id string, path string, sha256 string")

    def resumable(rows, present, contexts=None, single=False):
        valid = ledger.own_records_valid(ledger.latest_state(spark.createDataFrame(rows, STATE)), present, contexts)
        return [r.stage for r in ledger.resume_decisions(valid, single).collect() if r.resumable]

    assert resumable(rows, present) == [r[1] for r in rows]
    assert resumable(rows, present.withColumn("sha256", F.when(F.col("path") == "translate", "x").otherwise("h")))[-1] == "transcribe"
    newer = [*rows, ("j", "acquire", "complete", "99", "c", [("acquire", 1, "h")], 99)]
    assert resumable(newer, present) == ["acquire"]
    assert resumable([r for r in rows if r[1] != "evaluate-asr"], present, single=True)[-1] == "manifest"
    other = spark.createDataFrame([("j", "subtitles", "changed")], "job_id string, stage string, context_sha256 string")
    assert resumable(rows, present, other)[-1] == "translate"
    latest = ledger.latest_state(spark.createDataFrame(rows, STATE))
    assert ledger.overall_status(latest).first().status == "complete"
    assert resumable([(*r[:5], [], r[6]) for r in rows], present) == []


def test_receipts_manifest_and_outputs(spark):
    r = spark.createDataFrame([("a", "PASS", "local", "s", 3, "h"), ("b", "PASS", "ftp", "s", 3, "h"), ("c", "PASS", "local", "s", 3, "h"), ("d", "PASS", "local", "s", 3, "h")], "job_id string, status string, transport string, source_path string, bytes bigint, sha256 string")
    f = spark.createDataFrame([("a", "s", 3, "h", False), ("b", "s", 3, "h", False), ("c", "s", 3, "h", True)], "job_id string, path string, bytes bigint, sha256 string, writable boolean")
    assert {x.job_id: x.code for x in ledger.receipt_codes(r, f).collect()} == {"a": None, "b": "SOURCE_RECEIPT_INVALID", "c": "SOURCE_NOT_IMMUTABLE", "d": "SOURCE_MISSING"}
    stream = "array<struct<codec_type: string, codec_name: string, language: string>>"
    source = spark.createDataFrame([("a", 10.0, [("video", "h264", None), ("audio", "aac", None)])], f"job_id string, duration double, streams {stream}")
    made = spark.createDataFrame([("a", "soft", 10.5, [("video", "hevc", None), ("subtitle", "mov_text", "por")]), ("a", "burned", 10.0, [("video", "x", None), ("audio", "y", None)])], f"job_id string, output string, duration double, streams {stream}")
    assert [x.rule for x in ledger.output_checks(made, source).collect()] == ["subtitle language missing", "audio missing", "video codec changed", "audio codec changed", "duration drift"]
    probe = spark.createDataFrame([("a", json.dumps({"format": {}, "streams": [{"codec_type": "video", "width": 320, "height": 180, "duration": "12.0"}]})), ("b", "{}")], "job_id string, probe string")
    assert [tuple(x) for x in ledger.media_durations(probe).collect()] == [("a", 12.0, 320, 180), ("b", None, None, None)]
    h = spark.range(1).select(ledger.context_hash("translate", F.lit("c"), {}).alias("x"), ledger.context_hash("translate", F.lit("c"), {"asr/reference.json": F.lit("r")}).alias("y")).first()
    assert h.x != h.y


def test_redaction(spark):
    for text, secret in [("see https://x.example/a?token=abc now", "abc"), ("Authorization: Bearer abcdef", "abcdef"), ("Authorization: Basic Zm9v", "Zm9v"), ("Cookie: sid=42", "42"), ("password=hunter2&x=1", "hunter2")]:
        assert secret not in spark.range(1).select(redaction.redact_text(F.lit(text)).alias("t")).first().t
    fields = spark.createDataFrame([(k, v) for k, v in {"signed_url": "x", "api_key": "x", "access-key": "x", "Private_Key": "x", "note": "https://x.example", "stage": "a", "transport": "local", "sha256": "0" * 64, "tokens": "3"}.items()], "key string, value string")
    assert {r.key for r in redaction.refused_fields(fields).collect()} == {"signed_url", "api_key", "access-key", "Private_Key", "note"}
    assert redaction.refused_paths({"a": [{"api_key": 1}, {"b": "https://x.example"}], "stage": "x"}) == ["$.a[0].api_key", "$.a[1].b"]


CONFIG = """
schema_version = 1
[paths]
jobs_root = "{root}"
[languages]
source = "pt-BR"
target = "en"
[media]
[asr]
mode = "single"
candidates = ["p"]
[translation]
provider = "q"
[providers.p]
[providers.q]
[quality]
min_number_recall = 1.0
min_glossary_term_recall = 1.0
min_timing_iou = 0.5
minimum_translation_coverage = 1.0
minimum_confidence = 0.65
minimum_burned_frame_difference_ratio = 0.002
max_wer = 0.2
max_cer = 0.14
max_duration_drift_seconds = 0.35
smoke_decode_seconds = 8
frame_sample_count = 3
[subtitles]
max_chars_per_line = 42
max_lines = 2
max_chars_per_second = 20
min_cue_seconds = 1.0
max_cue_seconds = 7.0
minimum_gap_seconds = 0.08
formats = ["srt", "vtt"]
[render]
"""


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("ROOT_OF_JOBS", str(tmp_path / "jobs"))
    file = tmp_path / "c.toml"
    file.write_text(CONFIG.format(root="$ROOT_OF_JOBS"))
    c = load_config(file)
    assert c.jobs_root == (tmp_path / "jobs").resolve() and c.single and c.policy.max_lines == 2 and c.section("none") == {}
    with pytest.raises(ConfigError):
        load_config(file, tmp_path)
    for old, new in [('target = "en"', 'target = "de"'), ("max_wer = 0.2", "max_wer = -1"), ("max_wer = 0.2", ""), ('["p"]', '["p", "q"]'), ("frame_sample_count = 3", "frame_sample_count = true"), ('"vtt"]', '"ass"]'), ("min_cue_seconds = 1.0", "min_cue_seconds = 9"), ("[providers.q]", "")]:
        file.write_text(CONFIG.format(root="$ROOT_OF_JOBS").replace(old, new))
        with pytest.raises(ConfigError):
            load_config(file)


def test_workspace(tmp_path, spark):
    w = Workspace.create(tmp_path / "jobs", "job-1")
    assert os.stat(w.root).st_mode & 0o077 == 0
    assert os.stat(w.write_json("asr/x.json", {"stage": "a"})).st_mode & 0o777 == 0o600 and w.read_json("asr/x.json") == {"stage": "a"}
    for bad in (lambda: w.write_json("x.json", {"api_key": "a"}), lambda: w.resolve("../other"), lambda: w.ingest(tmp_path / "link.mp4")):
        (tmp_path / "link.mp4").unlink(missing_ok=True)
        (tmp_path / "link.mp4").symlink_to(tmp_path / "v.mp4")
        with pytest.raises(SensitiveDataError):
            bad()
    (tmp_path / "v.mp4").write_bytes(b"media")
    receipt = w.ingest(tmp_path / "v.mp4")
    assert receipt == w.ingest(tmp_path / "v.mp4") and receipt["sha256"] == sha256_file(w.source()) and os.stat(w.source()).st_mode & 0o777 == 0o400
    (tmp_path / "v.mp4").write_bytes(b"other")
    with pytest.raises(SensitiveDataError):
        w.ingest(tmp_path / "v.mp4")
    assert {r.sha256 for r in file_hashes(spark, str(w.root / "source")).collect()} == {receipt["sha256"]}
    os.chmod(w.root, 0o750)
    with pytest.raises(SensitiveDataError):
        Workspace.open(tmp_path / "jobs", "job-1")
    with pytest.raises(ConfigError):
        Workspace.create(tmp_path, "../x")


def test_engine(spark, tmp_path):
    assert plan(True)[0] == "normalize" and len(plan(True)) == 7 and len(plan(False)) == 9
    with pytest.raises(StageBlocked, match="UNKNOWN_STAGE"):
        plan(True, ["nothing"])
    done = lambda s, jobs: jobs.selectExpr("job_id", "'out' AS path", "1L AS bytes", "'h' AS sha256")

    def broken(_, jobs):
        raise ProviderError("no")

    e = Engine(spark, str(tmp_path), {s: done for s in ledger.ALL_STAGES} | {"translate": broken}, jobs=spark.createDataFrame([("j",)], "job_id string"))
    assert e.run(dry_run=True) == list(ledger.DEFAULT_STAGES)
    assert e.run(["normalize", "manifest"]) == ["normalize", "manifest"] and e.status().first().status == "complete"
    with pytest.raises(StageBlocked) as caught:
        e.run(["translate"])
    assert caught.value.code == "PROVIDER_FAILURE" and e.status().first().status == "blocked"
    last = {r.stage: r for r in ledger.latest_state(e.records()).collect()}
    assert (last["translate"].status, last["translate"].code) == ("blocked", "PROVIDER_FAILURE") and last["translate"].failed_at > last["translate"].started_at
    assert last["manifest"].status == "complete" and last["manifest"].started_at < last["manifest"].completed_at and len(last["manifest"].context_sha256) == 64


def test_engine_resumes_what_is_still_valid(spark, tmp_path):
    """Files of two jobs as a table; what a stage does is told by what it is given."""
    disk = {(j, "source/v.mp4"): f"source of {j}" for j in "ab"}
    did = []

    def stage(name):
        def run(s, jobs):
            mine = sorted(r.job_id for r in jobs.collect())
            did.append((name, "".join(mine)))
            for j in mine:
                disk[j, f"out/{name}"] = f"{name} of {j} {len(did)}"
            return s.createDataFrame([(j, f"out/{name}", 1, disk[j, f"out/{name}"]) for j in mine], "job_id string, path string, bytes bigint, sha256 string")

        return run

    present = lambda s: s.createDataFrame([(j, p, h) for (j, p), h in disk.items()], "job_id string, path string, sha256 string")
    stages = {s: stage(s) for s in ledger.ALL_STAGES}
    make = lambda config="one": Engine(spark, str(tmp_path), stages, True, spark.createDataFrame([("a",), ("b",)], "job_id string"), present, config)
    some = ["normalize", "transcribe", "translate"]
    e = make()
    e.acquired(spark.createDataFrame([(j, "source/v.mp4", 1, f"source of {j}") for j in "ab"], "job_id string, path string, bytes bigint, sha256 string"))
    assert e.run(some, resume=True) == some and did == [(s, "ab") for s in some]
    did.clear()
    assert make().run(some, resume=True) == [] and did == []
    disk["b", "out/transcribe"] = "changed"
    assert make().run(some, resume=True) == ["transcribe", "translate"] and did == [("transcribe", "b"), ("translate", "b")]
    did.clear()
    disk["a", "asr/reference.json"] = "new"  # what translating looks at
    assert make().run(some, resume=True) == ["translate"] and did == [("translate", "a")]
    did.clear()
    assert make("two").run(some[:1], resume=True) == some[:1] and did == [("normalize", "ab")]
    did.clear()
    e = make("two")
    e.acquired(spark.createDataFrame([("a", "source/v.mp4", 1, "source of a")], "job_id string, path string, bytes bigint, sha256 string"))
    assert e.run(["normalize"], resume=True) == ["normalize"] and did == [("normalize", "a")]  # the source came anew
    did.clear()
    assert make("two").run(["normalize"]) == ["normalize"] and did == [("normalize", "ab")]


def test_providers(spark):
    reg = providers.Registry()
    reg.register("fake", lambda segments, **_: [{"id": s["id"], "text": s["text"].upper()} for s in segments])
    rows = spark.createDataFrame([("j", k // 2, k, f"s{k}", f"t{k}") for k in range(3)], "job_id string, batch int, seq int, id string, text string")
    assert {(r.batch, r.text) for r in providers.translate(rows, reg.get("fake"), "pt-BR", "en", []).collect()} == {(0, "T0"), (0, "T1"), (1, "T2")}
    with pytest.raises(ProviderError):
        reg.get("other")
    with pytest.raises(ProviderError):
        providers.check_loopback("http://example.org/api")


def test_event_stream(spark, tmp_path):
    log = [("j", "a", "running", None, "2026-01-01 00:00:00"), ("j", "a", "blocked", "X", "2026-01-01 00:00:05"), ("j", "b", "complete", None, "2026-01-01 01:00:00")]
    (tmp_path / "1.json").write_text("".join(json.dumps(dict(zip(["job_id", "stage", "status", "code", "at"], x, strict=True))) + "\n" for x in log) + "not json\n")
    q = events.stage_states(events.read_events(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stage, r.status, r.code, r.events) for r in spark.table("states").collect()} == {("a", "blocked", "X", 2), ("b", "complete", None, 1)}
    q = events.blocked_rates(events.read_events(spark, str(tmp_path))).writeStream.outputMode("update").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stage, r.events, r.blocked) for r in spark.table("rates").collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "small.bin").write_bytes(b"y")
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.bytes, r.sha256) for r in file_hashes(spark, str(tmp_path), most_bytes=10).collect()}
    assert got == {n: (s, sha256_file(tmp_path / n)) for n, s in (("a b.bin", 3_000_000), ("small.bin", 1))}


def test_redacted_evidence_can_be_stored():
    from captionloom.functions.redaction import refused_paths

    assert refused_paths({"note": "Cookie: [REDACTED]", "line": ["token=[REDACTED]", "[REDACTED_URL]"], "stage": "x"}) == []
    assert refused_paths({"note": "Cookie: abc", "line": ["token=abc"], "access-key": 1, "a": {"url": 2}}) == ["$.note", "$.line[0]", "$.access-key", "$.a.url"]


def test_a_stream_without_input_has_no_rows(spark, tmp_path):
    from captionloom.streaming import events

    (tmp_path / "in").mkdir()
    run = lambda: sorted(tuple(r)[:3] for r in events.run_to_end(events.stage_states(events.read_events(spark, str(tmp_path / "in"))), folder=str(tmp_path / "state")).collect())
    assert run() == []
    (tmp_path / "in" / "one.json").write_text('{"job_id": "a", "stage": "render", "status": "running", "at": "2024-01-01T00:00:00Z"}\n')
    assert run() == [("a", "render", "running")]
    (tmp_path / "in" / "two.json").write_text('{"job_id": "a", "stage": "render", "status": "complete", "at": "2024-01-01T01:00:00Z"}\n')
    assert run() == [("a", "render", "complete")]  # goes on from its checkpoint
