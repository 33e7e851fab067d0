"""Published files: whole or not at all, and the same when read back."""

import os

import pytest

from captionloom.plans import rereads
from captionloom.sources import publish


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read().decode() for d, _, names in os.walk(root) for f in names}  # noqa: SIM115


def test_files_are_written_and_read_back(spark, tmp_path):
    srt = "1\n00:00:00,500 --> 00:00:03,000\nÄ 日本\n"
    rows = [(j, p, c) for j in ("a", "b é") for p, c in (("subtitles/en.srt", srt), ("x/empty.json", None), ("deep/er/y.txt", "long " * 100_000))]
    df = spark.createDataFrame(rows, "job_id string, path string, content string").repartition(3)
    root = tmp_path / "with space"
    publish.publish(df, f"file://{root}")
    assert tree(root) == {f"{j}/{p}": c or "" for j, p, c in rows}
    publish.publish(df.limit(0), str(root))  # nothing to do, nothing lost
    publish.publish(spark.createDataFrame([("a", "x/empty.json", "{}")], df.schema), str(root))
    assert tree(root)["a/x/empty.json"] == "{}"
    files = spark.createDataFrame([(k.split("/")[0], k.split("/", 1)[1], c) for k, c in tree(root).items()], df.schema)
    cues, codes = rereads.cues(files.select("job_id").distinct(), files)
    assert {(r.job_id, r.start_ms, r.text) for r in cues.collect()} == {("a", 500, "Ä 日本"), ("b é", 500, "Ä 日本")} and codes.filter("code is not null").count() == 0


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    root = tmp_path / "out"
    good = [("a", f"f{k}", "x") for k in range(20)]
    for bad in ("../up", "/abs", "a//b", "", None):
        with pytest.raises(Exception, match="leaves the folder|WRITE"):
            publish.publish(spark.createDataFrame([*good, ("b", bad, "x")], "job_id string, path string, content string").repartition(4), str(root), "{path}")
        # What a task wrote before it was stopped may stay where no reader looks.
        assert not root.exists() or [p for p in tree(root) if not p.startswith(publish.STAGING)] == []
    with pytest.raises(ValueError, match="one path"):
        publish.publish(spark.createDataFrame([("a", "p", "1"), ("a", "p", "2")], "job_id string, path string, content string"), str(root))


def test_a_task_that_runs_again_publishes_once(tmp_path):
    writer = publish.FileWriter(str(tmp_path / "out"), False)
    row = lambda p, c: {"path": p, "content": c}
    lost = writer.write(iter([row("a/1", "half")]))  # an attempt whose executor is lost: its message never arrives
    kept = writer.write(iter([row("a/1", "whole")]))
    assert lost.listing != kept.listing and "a" not in os.listdir(tmp_path / "out")
    writer.commit([kept, None])
    assert tree(tmp_path / "out") == {"a/1": "whole"}
    other = publish.FileWriter(str(tmp_path / "out"), False)
    other.write(iter([row("a/2", "x")]))
    other.abort([None])
    assert tree(tmp_path / "out") == {"a/1": "whole"}
