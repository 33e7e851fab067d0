"""Texts and evaluations are made once for a query, however many sides of it read them."""

from captionloom.operators import metrics
from captionloom.plans import queries


def test_transcript_text_needs_no_join(spark):
    rows = spark.createDataFrame([("a", 2, " y "), ("a", 1, "x"), ("a", 3, " "), ("b", 1, ""), ("c", 1, None)], "job_id string, seq int, text string")
    made = metrics.transcript_text(rows, ["job_id"])
    assert {tuple(r) for r in made.collect()} == {("a", "x y"), ("b", ""), ("c", "")}
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_bake_off_reads_written_evaluations(spark, tmp_path):
    spark.createDataFrame([(k, t, "user", f"some words {k} of turn {t} and the rest") for k in range(6) for t in range(3)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = queries.bake_off_of_tracks(spark, str(tmp_path))
    assert "conversations.parquet" not in "".join(made.inputFiles())
    assert made.count() == 6
