import gzip
import os
import tempfile

from sojourn.sources.csv_events import read_job_events, read_task_events

BAD = "\n".join([
    "100,,1,0,5,0,alice,1,2,0.5,0.25,0.1,0",      # good
    "200,,1,0,,1,,1,2,0.5,0.25,0.1,0",            # empty fields -> NULL
    ",,2,0,5,0,bob,1,2,0.5,0.25,0.1,0",           # empty timestamp -> NULL, kept
    "abc,,3,0,5,0,carl,1,2,0.5,0.25,0.1,0",       # non-numeric timestamp -> dropped
    "300,,4,0,5,0,dan,x,2,0.5,0.25,0.1,0",        # non-numeric sclass -> dropped
    "400,,5,0,5,0,eve",                           # short row -> dropped
    "500,,6,0,5,0,fay,1,2,0.5,0.25,0.1,0,99",     # long row -> dropped
    "600,,7,0,5,0,NULL,1,2,0.5,0.25,0.1,0",       # NULL username
]) + "\n"


def _write(text, name):
    d = tempfile.mkdtemp(prefix="sojourn-csv-", dir="/tmp")
    p = os.path.join(d, name)
    with gzip.open(p, "wt") as f:
        f.write(text)
    return p


def test_task_reader_drops_malformed_rows_for_any_projection(spark):
    df = read_task_events(spark, _write(BAD, "t.csv.gz"))
    full = df.collect()
    assert sorted(r.jobid for r in full) == [1, 1, 2, 7]
    assert df.count() == 4
    assert df.select("jobid").count() == 4
    assert df.select("username").where("username IS NULL").count() == 2
    assert [r.timestamp for r in full if r.jobid == 2] == [None]
    assert read_task_events(spark, _write(BAD, "t2.csv.gz"), require_keys=True).count() == 3


def test_job_reader_drops_name_columns(spark):
    text = "10,,1,0,u1,2,name,lname\n11,,1,1,u1,2,name,lname\nbad,,1,1,u1,2,n,l\n"
    df = read_job_events(spark, _write(text, "j.csv.gz"))
    assert df.columns == ["timestamp", "missing", "jobid", "evtype", "username", "sclass"]
    assert df.count() == 2


def test_exponential_process_moments(spark):
    from sojourn.sources.synthetic import exponential_process

    proc, stats = exponential_process(spark, rate=2.0, num=20000, seed=3)
    st = stats.collect()[0]
    assert st.n == 20000
    assert abs(st.mean_raw / st.c - 0.5) < 0.02
    rows = proc.orderBy("idx").select("raw", "pre").collect()
    assert rows[0].pre == 0 and rows[5].pre == sum(r.raw for r in rows[:5])


def test_reader_takes_lists_and_globs(spark):
    a = _write("1,,1,0,1,0,u,0,0,0.1,0.1,0.1,0\n", "part-00000-of-00002.csv.gz")
    b = _write("2,,2,0,1,0,u,0,0,0.1,0.1,0.1,0\nbad\n", "part-00001-of-00002.csv.gz")
    assert read_task_events(spark, [a, b]).count() == 2
    d = os.path.dirname(a)
    c = os.path.join(d, "part-00001-of-00002.csv.gz")
    with gzip.open(c, "wt") as f:
        f.write("3,,3,0,1,0,u,0,0,0.1,0.1,0.1,0\n")
    assert sorted(r.jobid for r in read_task_events(spark, os.path.join(d, "part-*.csv.gz")).collect()) == [1, 3]


def test_long_files_that_cannot_be_split_are_read_once_and_dealt(spark, tmp_path, monkeypatch):
    from sojourn.operators.summary import summary_from_files
    from sojourn.sources import csv_events as ce
    from sojourn.sources.schema import JOB_SCHEMA_KEPT, TASK_SCHEMA

    te = spark.createDataFrame([(5 + k, None, k, 0, 1, e, "u", 0, 0, 0.1, 0.1, 0.1, 0) for k in range(500) for e in (0, 1, 4)], TASK_SCHEMA)
    je = spark.createDataFrame([(5, None, 1, 0, "u", 0), (20, None, 1, 4, "u", 0)], JOB_SCHEMA_KEPT)
    ce.write_task_events_csv(te.coalesce(1), str(tmp_path / "t"))
    ce.write_job_events_csv(je.coalesce(1), str(tmp_path / "j"))
    assert len([n for n in ce.file_lengths(spark, str(tmp_path / "t")) if n.endswith(".gz")]) == 1
    assert ce.file_lengths(spark, [str(tmp_path / "t" / "*.gz"), str(tmp_path / "none*")])
    monkeypatch.setattr(ce, "SPLIT_BYTES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows: else joined to one file again
    try:
        events = ce.read_once(spark, ce.read_task_events, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(events.inputFiles()) > 1 and sorted(map(str, events.collect())) == sorted(map(str, te.collect()))
    for frame in summary_from_files(spark, str(tmp_path / "t"), str(tmp_path / "j")).values():
        assert "csv" not in frame._jdf.queryExecution().executedPlan().toString().lower()
