from pyspark.sql import functions as F

from sojourn.operators import lifecycle as lc
from sojourn.operators import metadata as md
from sojourn.sources.schema import TASK_SCHEMA


def ev(ts, job, task, code, user="u"):
    return (ts, None, job, task, 1, code, user, 0, 0, 0.1, 0.1, 0.1, 0)


EDGE = [
    ev(0, 1, 0, 0), ev(10, 1, 0, 1), ev(20, 1, 0, 4),                 # event at time 0: never arrived
    ev(5, 2, 0, 0), ev(30, 2, 0, 4),                                   # finish without schedule
    ev(7, 3, 0, 0),                                                    # submit only
    ev(3, 4, 0, 0, "a"), ev(9, 4, 0, 0, "b"), ev(12, 4, 0, 1), ev(20, 4, 0, 4),  # two submits
    ev(10, 5, 0, 0), ev(5, 5, 0, 1),                                   # schedule before arrive
    ev(1, 6, 0, 0), ev(2, 6, 0, 1), ev(3, 6, 0, 2), ev(4, 6, 0, 3), ev(5, 6, 0, 5), ev(6, 6, 0, 6),
    ev(2, 7, 0, 0), ev(50, 7, 0, 9),                                   # unknown code ignored
]


def test_task_lifecycle_edge_cases(spark):
    df = spark.createDataFrame(EDGE, TASK_SCHEMA)
    rows = {r.jobid: r for r in lc.task_lifecycle(df).collect()}
    assert set(rows) == {2, 3, 4, 6, 7}
    assert (rows[2].schedule, rows[2].finish, rows[2].size, rows[2].waittime) == (0, 30, 30, -1)
    assert (rows[3].size, rows[3].waittime) == (0, -1)
    assert (rows[4].arrive, rows[4].size, rows[4].waittime) == (9, 8, 3)
    r6 = rows[6]
    assert (r6.evict, r6.fail, r6.kill, r6.lost, r6.generalfailure, r6.size, r6.waittime) == (3, 4, 5, 6, 6, -1, 1)
    assert (rows[7].finish, rows[7].size) == (0, 0)


def test_metadata_join_fans_out_per_submit(spark):
    df = spark.createDataFrame(EDGE, TASK_SCHEMA)
    meta = md.task_lifecycle_meta(df)
    assert len(meta.columns) == 19
    assert meta.where(F.col("jobid") == 4).count() == 2
    dedup = md.task_lifecycle_meta(df, dedupe_submits=True).where(F.col("jobid") == 4).collect()
    assert [r.username for r in dedup] == ["b"]
    counts = {r.evtype: r["count"] for r in lc.event_type_counts(df).collect()}
    assert counts[0] == 8 and counts[9] == 1
