"""Caption files as a source: many in a task, filters on the path, bad files as rows."""

import pytest
from pyspark.sql import functions as F

from captionloom.sources import captions


def test_many_files_in_few_tasks_and_pushed_paths(spark, tmp_path):
    captions.register(spark)
    for k in range(60):
        folder = tmp_path / f"j {k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.srt").write_text(f"1\n00:00:0{k % 9},000 --> 00:01:00,500\nÄ cue of {k}\n\n2\n00:02:00,000 --> 00:02:01,000\nmore\n")
    (tmp_path / "other.txt").write_text("no")
    read = spark.read.format("srt").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 1 and read.count() == 120
    assert {r.text for r in read.filter("index = 1").collect()} == {f"Ä cue of {k}" for k in range(60)}
    one = str(tmp_path / "j 1" / "4.srt")
    assert [(r["path"], r["index"]) for r in read.filter(F.col("path") == one).orderBy("index").collect()] == [(one, 1), (one, 2)]
    assert read.filter(F.col("path").isin(one, "none")).count() == 2
    (tmp_path / "j 0" / "0.srt").write_bytes(b"\xff\xfe broken")  # not opened, as its path is not asked for
    assert spark.read.format("srt").load(str(tmp_path)).filter(F.col("path") == one).count() == 2


def test_bad_files_are_rows_if_asked_for(spark, tmp_path):
    captions.register(spark)
    (tmp_path / "good.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhello\n")
    (tmp_path / "bad.vtt").write_bytes(b"WEBVTT\n\n\xff\xfe")
    (tmp_path / "none.vtt").write_text("WEBVTT\n")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.code) for r in spark.read.format("vtt").option("errors", "rows").load(str(tmp_path)).collect()}
    assert got == {"good.vtt": ("hello", None), "bad.vtt": (None, "SUBTITLES_INVALID"), "none.vtt": (None, "SUBTITLES_EMPTY")}
    with pytest.raises(Exception, match="decode"):
        spark.read.format("vtt").load(str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("vtt").load(str(tmp_path / "empty")).count() == 0
