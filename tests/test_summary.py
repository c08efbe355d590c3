from sojourn.operators.summary import histogram, trace_summary
from sojourn.sources.schema import JOB_SCHEMA_KEPT, TASK_SCHEMA


def test_histogram_last_bucket_closed_and_empty_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 2, 10)], "size long")
    rows = [(r.bucket, r.lo, r.hi, r["count"]) for r in histogram(df, "size", 5).orderBy("bucket").collect()]
    assert rows == [(0, 0.0, 2.0, 2), (1, 2.0, 4.0, 2), (2, 4.0, 6.0, 0), (3, 6.0, 8.0, 0), (4, 8.0, 10.0, 1)]


def test_histogram_constant_column_is_one_bucket(spark):
    df = spark.createDataFrame([(3,), (3,)], "size long")
    assert [(r.bucket, r["count"]) for r in histogram(df, "size", 5).collect()] == [(0, 2)]


def test_trace_summary_frames(spark):
    te = spark.createDataFrame([(5, None, 1, 0, 1, 0, "u", 0, 0, 0.1, 0.1, 0.1, 0),
                                (9, None, 1, 0, 1, 1, "u", 0, 0, 0.1, 0.1, 0.1, 0),
                                (20, None, 1, 0, 1, 4, "u", 0, 0, 0.1, 0.1, 0.1, 0)], TASK_SCHEMA)
    je = spark.createDataFrame([(5, None, 1, 0, "u", 0), (20, None, 1, 4, "u", 0)], JOB_SCHEMA_KEPT)
    out = trace_summary(spark, te, je)
    prof = {r.name: r.rows for r in out["profile"].collect()}
    assert prof == {"task_events": 3, "job_events": 2, "task_lifecycle": 1, "job_lifecycle": 1,
                    "task_lifecycle_meta": 1, "job_lifecycle_meta": 1}
    assert [r["count"] for r in out["size_histogram"].collect()] == [1]
    assert out["tasks"].collect()[0].size == 11
