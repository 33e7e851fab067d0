"""The sample's pictures, against their definition point by point, and no work for each point."""

from captionloom.plans import stage_queries


def test_pictures_follow_from_event_and_place(spark, tmp_path):
    numbers = [*range(0, 700), *range(6_500, 6_700), 123_456_789_012]
    spark.createDataFrame([(n,) for n in numbers], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    source, burned = stage_queries._frames(spark, str(tmp_path))
    value = lambda e, i: (e * 7 + i * 13) % 200
    over = lambda e, i: (value(e, i) + 20 + e % 10) % 256 if e % 11 != 3 and i % 9 < e % 6 else value(e, i)
    for side, of in ((source, value), (burned, over)):
        rows = side.collect()
        assert len(rows) == len([n for n in numbers if side is source or n % 97 != 8])
        for r in rows:
            e = int(r["job_id"]) * 8 + r["ordinal"]
            hollow = side is burned and e % 83 == 9
            assert bytes(r["pixels"]) == (b"" if hollow else bytes(of(e, i) for i in range(90)))
        assert "transform(" not in side._jdf.queryExecution().optimizedPlan().toString()
