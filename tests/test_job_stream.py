"""An engine's events followed as a stream: as the ledger has them after replays and a restart."""

import shutil

from captionloom.plans.engine import Engine
from captionloom.streaming import events, jobs


def test_stream_equals_ledger_after_replay_and_restart(spark, tmp_path):
    out = "job_id string, path string, bytes bigint, sha256 string, code string"

    def stage(bad):
        return lambda s, todo: s.createDataFrame([(r.job_id, "p", 1, "h", "X" if r.job_id in bad else None) for r in todo.collect()], out)

    frame = lambda *names: spark.createDataFrame([(j,) for j in names], "job_id string")
    engine = Engine(spark, str(tmp_path / "ledger"), {"normalize": stage("b"), "transcribe": stage("c"), "manifest": stage("")}, jobs=frame(*"abc"))
    follow = lambda: {r.job_id: (r.status, r.code) for r in jobs.follow(jobs.job_changes(events.read_events(spark, str(tmp_path / "ledger/events"))), str(tmp_path / "stream")).collect()}
    ledger = lambda: {r.job_id: r.status for r in engine.status().collect()}
    engine.run(["normalize"])
    assert {r.job_id for r in engine.events().collect()} == set("abc") and engine.events().filter("attempt is null or at is null").count() == 0
    first = follow()
    assert first == {"a": ("in_progress", None), "b": ("blocked", "X"), "c": ("in_progress", None)} and {k: s for k, (s, _) in first.items()} == ledger()
    engine.run(["transcribe"])
    shutil.copytree(tmp_path / "ledger/events", tmp_path / "ledger/events/replayed")  # all events so far once more
    engine.run(["manifest"])
    now = follow()  # goes on from its checkpoint
    assert {k: s for k, (s, _) in now.items()} == ledger()
    assert follow() == now
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "stream/changes"))
    assert rows.count() == rows.select("job_id", "changes").distinct().count()  # no change twice


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    schema = "job_id string, stage string, status string, code string, attempt string, at timestamp"
    lines = [("j", "normalize", "running", "1", "2026-01-01T00:00:00"), ("j", "normalize", "blocked", "1", "2026-01-01T00:00:05"), ("j", "normalize", "running", "2", "2026-01-01T00:01:00"), ("j", "manifest", "complete", "3", "2026-01-01T00:02:00"), (None, "x", "running", "9", "2026-01-01T00:03:00")]
    for k, order in enumerate(([0, 1, 2, 3, 4], [3, 4, 0], [3, 2, 1, 0, 0])):
        folder = tmp_path / str(k)
        rows = [(j, s, st, None, a, at) for i in order for j, s, st, a, at in [lines[i]]]
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.json(str(folder / "in"))
        got = jobs.follow(jobs.job_changes(events.read_events(spark, str(folder / "in"))), str(folder / "out")).collect()
        assert [(r.job_id, r.status) for r in got] == [("j", "complete")]
    (tmp_path / "empty").mkdir()
    assert jobs.follow(jobs.job_changes(events.read_events(spark, str(tmp_path / "empty"))), str(tmp_path / "none")).count() == 0
