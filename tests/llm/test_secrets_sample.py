"""Labelled findings beyond the bound are drawn from all rows of both labels."""

from captionloom.llm import secrets as s


def test_sorted_findings_are_sampled(spark, monkeypatch):
    schema = "left string, candidate string, right string, path string, label int"
    rows = sorted(s.labelled_findings(600, seed=4), key=lambda r: r[4])
    monkeypatch.setattr(s, "FINDINGS", 200)
    first, second = (spark.createDataFrame(x, schema) for x in (rows, rows[::-1]))
    got = s._sample(first).collect()
    assert [sum(r.label == y for r in got) for y in (0, 1)] == [100, 100] and got == s._sample(second).collect()
    few = spark.createDataFrame(rows[:190] + rows[-10:], schema)
    assert s._sample(few).count() == 200
    trees = s.forest(spark, first)
    assert trees == s.forest(spark, second) and any(not isinstance(t, float) for t in trees)
