"""Jobs' states go from batch to batch by tables; no job costs a Python call."""

from pathlib import Path

from captionloom.streaming import events, jobs

EVENTS = "job_id string, stage string, status string, code string, attempt string, at string"


def _send(spark, folder, *rows):
    made = [(job, stage, status, "X" if status == "blocked" else None, f"{job}{minute}{stage}", f"2026-01-01T00:{minute:02}:00") for job, minute, stage, status in rows]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").json(str(folder / "in"))


def _follow(spark, folder):
    last = jobs.follow(jobs.job_changes(events.read_events(spark, str(folder / "in"))), str(folder / "out"))
    return {r.job_id: (r.status, r.stage, r.code, r.at.minute, r.changes) for r in last.collect()}


def test_no_job_costs_a_python_call(spark, tmp_path):
    plan = jobs.job_changes(events.read_events(spark, str(tmp_path)))._jdf.queryExecution().logical().toString()
    assert "DeduplicateWithinWatermark" in plan and "Python" not in plan and "PySpark" not in plan and "InPandas" not in plan
    held = spark.createDataFrame([], jobs.HELD)
    batch = spark.createDataFrame([], "job_id string, stage string, status string, code string, at timestamp")
    plan = jobs.changes_of(batch, held)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1


def test_states_are_held_between_batches(spark, tmp_path):
    _send(spark, tmp_path, ("a", 5, "normalize", "complete"), ("a", 6, "transcribe", "blocked"), ("b", 5, "normalize", "running"), ("c", 9, "manifest", "complete"))
    assert _follow(spark, tmp_path) == {"a": ("blocked", "transcribe", "X", 6, 2), "b": ("in_progress", "normalize", None, 5, 1), "c": ("complete", "manifest", None, 9, 1)}
    # b's newest event moves on without a change of state; a's and c's older events and those of equal time and lesser stage change nothing.
    _send(spark, tmp_path, ("b", 8, "normalize", "complete"), ("a", 4, "manifest", "complete"), ("a", 6, "render", "running"), ("c", 8, "render", "blocked"))
    assert _follow(spark, tmp_path) == {"a": ("blocked", "transcribe", "X", 6, 2), "b": ("in_progress", "normalize", None, 5, 1), "c": ("complete", "manifest", None, 9, 1)}
    _send(spark, tmp_path, ("b", 7, "render", "blocked"), ("a", 6, "validate", "complete"), ("d", 1, "normalize", "running"))
    now = {"a": ("in_progress", "validate", None, 6, 3), "b": ("in_progress", "normalize", None, 5, 1), "c": ("complete", "manifest", None, 9, 1), "d": ("in_progress", "normalize", None, 1, 1)}
    assert _follow(spark, tmp_path) == now
    # A batch whose end was not noted is run again, upon what was held before it.
    commits = tmp_path / "out/checkpoint/commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(commits / f".{last.name}.crc").unlink(missing_ok=True)
    assert _follow(spark, tmp_path) == now
    _send(spark, tmp_path, ("c", 10, "render", "blocked"), ("d", 2, "manifest", "complete"))
    assert _follow(spark, tmp_path) == now | {"c": ("blocked", "render", "X", 10, 2), "d": ("complete", "manifest", None, 2, 2)}
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/changes"))
    assert sorted((r.job_id, r.changes) for r in rows.select("job_id", "changes").collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 2)]
