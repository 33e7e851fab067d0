"""What a Python worker is sent at once is bounded for every query."""

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from captionloom import session


@pytest.mark.parametrize("name", ["tokenize_documents", "select_winner"])
def test_queries_bound_the_batches(spark, monkeypatch, name):
    rows, most = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(rows)
    spark.conf.unset(most)
    query = entry._ready(lambda s, folder: (s, folder))
    assert name in entry.queries()
    query(spark, "")
    sizes = spark.range(2000, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert max(r["n"] for r in sizes) <= session.BATCH_ROWS
    assert int(spark.conf.get(most).rstrip("b")) == session.BATCH_BYTES


def test_smaller_bounds_are_kept(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    session.bound_batches(spark)
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)
