import json
import urllib.error

import numpy as np
import pytest

from captionloom import cli
from captionloom.operators import transcripts
from captionloom.operators.cues import Policy
from captionloom.plans import flows
from captionloom.plans.engine import MediaError, ProviderError, ProviderUnavailable
from captionloom.sources import captions, media, services
from tests.test_ledger_engine import CONFIG


def test_from_audio_chunks_to_captions(spark):
    said = {0: [("one", 0.2, 1.2, "Ana viu 42 casos.")], 1: [("two", 0.0, 1.0, "Foi assim."), ("three", 4.8, 5.8, "Fim.")]}

    def recogniser(path, *, language, min_confidence):
        part = int(path[-1])
        return json.dumps({"segments": [{"id": k, "start": s, "end": e, "text": t, "avg_logprob": -0.01} for k, (_, s, e, t) in enumerate(said[part])]})

    chunks = spark.createDataFrame([("j", 0, 0.0, "p0"), ("j", 1, 5.0, "p1")], "job_id string, part int, offset double, path string")
    length = spark.createDataFrame([("j", 12.0)], "job_id string, duration double")
    heard = flows.transcribe(chunks, length, recogniser, transcripts.parse_scored_segments)
    rows = heard.segments.orderBy("seq").collect()
    assert [(r.id, r.start, r.end) for r in rows] == [("part1-ow-1", 0.2, 1.2), ("part2-ow-1", 5.0, 6.0), ("part2-ow-2", 9.8, 10.8)]
    assert heard.report.first().asDict() == {"job_id": "j", "status": "PASS", "segment_count": 3, "uncertain_segment_count": 0, "violation_count": 0}
    english = {"part1-ow-1": "Ana saw 42 cases.", "part2-ow-1": "It was so.", "part2-ow-2": "The end."}
    done, wrong = flows.translate(heard.segments, lambda segments, **_: [{"id": s["id"], "text": english[s["id"]]} for s in segments], ["Ana"], 2)
    assert wrong.count() == 0 and [r.text for r in done.orderBy("seq").collect()] == list(english.values())
    made = flows.subtitle(done, length, Policy())
    assert made.violations.count() == 0 and made.coverage.first().covered
    assert captions.parity(captions.parse_srt(made.srt, ["job_id"]), captions.parse_vtt(made.vtt, ["job_id"]), ["job_id"]).first().equal


def test_bake_off_with_clips(spark):
    row = "job_id string, candidate string, seq int, start_ms bigint, end_ms bigint, text string"
    ref = spark.createDataFrame([("j", "", 0, 0, 1000, "a b c"), ("j", "", 1, 60_000, 61_000, "z")], row).drop("candidate")
    cand = spark.createDataFrame([("j", "native", 0, 0, 1000, "a b c"), ("j", "native", 1, 60_000, 61_000, "z"), ("j", "other", 0, 0, 1000, "a b c"), ("j", "other", 1, 60_000, 61_000, "z")], row)
    none = spark.createDataFrame([], "job_id string, term string")
    clips = spark.createDataFrame([("j", 0.0, 10.0)], "job_id string, start double, length double")
    judged, won = flows.bake_off(ref, cand, none, none.withColumnRenamed("term", "number"), clips)
    assert {r.candidate: r.wer for r in judged.collect()} == {"native": 0.25, "other": 0.0} and won.first().selected == "other"


def test_media_commands():
    assert media.mux_command("a.mp4", "b.srt", "c.mp4")[-1] == "c.mp4" and "mov_text" in media.mux_command("a.mp4", "b.srt", "c.mp4") and "srt" in media.mux_command("a", "b", "c.mkv")
    assert "16000" in media.normalize_command("a", "b") and media.clip_command("a", "b", 1.5, 2)[7:10] == ["1.500", "-t", "2.000"]
    assert media.probe_summary({"streams": [{"index": 0, "codec_type": "audio", "duration": "3.5", "tags": {"language": "eng"}}]}) == {"duration": 3.5, "streams": [{"index": 0, "codec_type": "audio", "language": "eng"}]}
    a = np.zeros((100, 4, 3), np.uint8)
    b = a.copy()
    b[90:] = 200
    assert media.lower_difference(a, b) == pytest.approx(10 / 55) and media.lower_difference(a, a) == 0
    with pytest.raises(MediaError):
        media.run(["no-such-tool-here"])
    assert media.tool_version("no-such-tool-here") == "unavailable"


def test_services(monkeypatch, tmp_path):
    (tmp_path / "a.flac").write_bytes(b"x")
    monkeypatch.delenv("NO_SUCH_CREDENTIAL", raising=False)
    with pytest.raises(ProviderUnavailable):
        services.RawAudioService("https://asr.invalid", "NO_SUCH_CREDENTIAL")(str(tmp_path / "a.flac"), language="pt-BR", min_confidence=0.5)
    body, kind = services.multipart({"model": "m"}, "file", tmp_path / "a.flac")
    assert kind.split("=")[1].encode() in body and b'name="model"' in body
    assert services.output_text({"output": [{"type": "message", "content": [{"type": "output_text", "text": "t"}]}]}) == "t"
    with pytest.raises(ProviderError):
        services.ChatTranslator("https://example.invalid/chat", "m")([], source_language="a", target_language="b", terms=[])

    def refuse(*_a, **_k):
        raise urllib.error.URLError("no network")

    monkeypatch.setattr(services.urllib.request.OpenerDirector, "open", refuse)
    with pytest.raises(ProviderError):
        services.request_json("https://example.invalid", b"", {})


def test_cli(tmp_path, capsys, spark):
    file = tmp_path / "c.toml"
    file.write_text(CONFIG.format(root=tmp_path / "jobs"))
    common = ["--config", str(file), "--job-id", "j1"]
    assert cli.main(["init", *common]) == 0 and json.loads(capsys.readouterr().out)["status"] == "initialized"
    assert cli.main(["run", *common, "--dry-run"]) == 0 and json.loads(capsys.readouterr().out)["stages"][-1] == "manifest"
    (tmp_path / "v.mp4").write_bytes(b"media")
    assert cli.main(["ingest", *common, str(tmp_path / "v.mp4")]) == 0 and str(tmp_path) not in capsys.readouterr().out
    assert cli.main(["ingest", *common, str(tmp_path / "none.mp4")]) == 2 and json.loads(capsys.readouterr().err) == {"error": "LOCAL_IO_FAILURE"}
    assert cli.main(["run", *common, "--stages", "nothing"]) == 2 and json.loads(capsys.readouterr().err) == {"error": "UNKNOWN_STAGE"}


def test_cli_runs_and_resumes_stages(tmp_path, capsys, spark):
    file = tmp_path / "c.toml"
    file.write_text(CONFIG.format(root=tmp_path / "jobs"))
    common = ["--config", str(file), "--job-id", "j2"]
    (tmp_path / "v.mp4").write_bytes(b"media")
    assert cli.main(["ingest", *common, str(tmp_path / "v.mp4")]) == 0
    audio = tmp_path / "jobs" / "j2" / "audio" / "a.wav"

    def normalize(s, jobs):
        audio.write_bytes(b"sound")
        return jobs.selectExpr("job_id", "'audio/a.wav' AS path", "5L AS bytes", "sha2('sound', 256) AS sha256")

    run = lambda *more: (capsys.readouterr(), cli.main(["run", *common, "--stages", "normalize", *more], {"normalize": normalize}), json.loads(capsys.readouterr().out)["stages"])[1:]
    assert run("--resume") == (0, ["normalize"]) and run("--resume") == (0, []) and run() == (0, ["normalize"])
    audio.write_bytes(b"other")
    assert run("--resume") == (0, ["normalize"])
    assert cli.main(["status", *common]) == 0 and json.loads(capsys.readouterr().out)["jobs"] == [{"job_id": "j2", "status": "in_progress"}]
