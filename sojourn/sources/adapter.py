"""Turn the ``events`` test table into task and job trace events.

The test tables carry no cluster trace, so a fixed rule maps the event stream
onto trace rows: 4 users, 8 events per job, 2 tasks per job, one event per
(task, position) with position = seq % 4.

Fixed values (the adapter rule, shared with the SQL oracle):
  g         = user_id % 4
  seq       = 0-based rank of event_id within g;  prev = event_type of seq-1
  pos       = seq % 4
  timestamp = microseconds from 2024-01-01 00:00:00
  jobid     = (seq div 8) * 4 + g
  taskix    = (seq div 4) % 2
  machineid = event_id % 100;  username = 'u' || g
  sclass    = event_id % 4;    priority = event_id % 12
  cpureq, ramreq, hdreq = value / 1000, value / 2000, value / 4000
  constraint = 0;  missing = NULL
  evtype    pos 0: 0
            pos 1: 8 if event_type = 'error' else 1
            pos 2: 7 if prev = 'error'; else if event_type = 'error':
                   2, 3, 5, 6 for event_id % 4 = 0, 1, 2, 3; else 4
            pos 3: 0 if event_type = 'signup' else 7
Job events: the same rows without (taskix = 1 and pos = 0), job columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import ordered_index
from .tables import table

EPOCH = "2024-01-01 00:00:00"
USERS = 4
JOB_SPAN = 8
EVENTS_PER_TASK = 4


def _trace_rows(events: DataFrame, block_rows: int) -> DataFrame:
    ev = events.select(
        "event_id", "ts", "event_type", "value", (F.col("user_id") % USERS).alias("g")
    )
    # rank within g without one task per g (g has only 4 values)
    ev = ordered_index(
        ev, ["g"], ["event_id"], idx_col="seq", prev_of="event_type", prev_col="prev",
        block_rows=block_rows,
    )
    pos = F.col("seq") % EVENTS_PER_TASK
    fail_code = (
        F.when(F.col("event_id") % 4 == 0, 2)
        .when(F.col("event_id") % 4 == 1, 3)
        .when(F.col("event_id") % 4 == 2, 5)
        .otherwise(6)
    )
    is_err = F.col("event_type") == "error"
    evtype = (
        F.when(pos == 0, 0)
        .when(pos == 1, F.when(is_err, 8).otherwise(1))
        .when(pos == 2, F.when(F.col("prev") == "error", 7).when(is_err, fail_code).otherwise(4))
        .otherwise(F.when(F.col("event_type") == "signup", 0).otherwise(7))
    )
    return ev.select(
        F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts)").cast("long").alias("timestamp"),
        F.lit(None).cast("int").alias("missing"),
        (F.expr(f"seq div {JOB_SPAN}") * USERS + F.col("g")).cast("long").alias("jobid"),
        (F.expr(f"seq div {EVENTS_PER_TASK}") % 2).cast("long").alias("taskix"),
        (F.col("event_id") % 100).cast("long").alias("machineid"),
        evtype.cast("int").alias("evtype"),
        F.concat(F.lit("u"), F.col("g").cast("string")).alias("username"),
        (F.col("event_id") % 4).cast("int").alias("sclass"),
        (F.col("event_id") % 12).cast("int").alias("priority"),
        (F.col("value") / 1000).alias("cpureq"),
        (F.col("value") / 2000).alias("ramreq"),
        (F.col("value") / 4000).alias("hdreq"),
        F.lit(0).alias("constraint"),
        pos.cast("int").alias("_pos"),
    )


_WRITTEN: dict[tuple, str] = {}


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter output, written once per session and version of the input files as parquet in
    the shared checkpoint folder and read back (a trace arrives as files; this
    also cuts the adapter's lineage so later plans start from a scan)."""
    from ..session import input_version, scratch_path

    key = (spark.sparkContext.applicationId, sf_dir, input_version(spark, f"{sf_dir}/events.parquet"))
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, "trace-rows")
        _trace_rows(table(spark, sf_dir, "events"), 1 << 16).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_rows(spark, sf_dir).drop("_pos")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir)
    return rows.where(~((F.col("taskix") == 1) & (F.col("_pos") == 0))).select(
        "timestamp", "missing", "jobid", "evtype", "username", "sclass"
    )


# The same rule in SQL, for the DuckDB oracle (tables: events).
ORACLE_TRACE_CTE = """
adapter_ev AS (
  SELECT event_id, ts, event_type, value, user_id % 4 AS g,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS seq,
         lag(event_type) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS prev
  FROM events
),
adapter_rows AS (
  SELECT CAST(datediff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS "timestamp",
         CAST(NULL AS INTEGER) AS missing,
         CAST((seq // 8) * 4 + g AS BIGINT) AS jobid,
         CAST((seq // 4) % 2 AS BIGINT) AS taskix,
         CAST(event_id % 100 AS BIGINT) AS machineid,
         CAST(CASE seq % 4
           WHEN 0 THEN 0
           WHEN 1 THEN CASE WHEN event_type = 'error' THEN 8 ELSE 1 END
           WHEN 2 THEN CASE WHEN prev = 'error' THEN 7
                            WHEN event_type = 'error' THEN
                              CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END
                            ELSE 4 END
           ELSE CASE WHEN event_type = 'signup' THEN 0 ELSE 7 END
         END AS INTEGER) AS evtype,
         'u' || CAST(g AS VARCHAR) AS username,
         CAST(event_id % 4 AS INTEGER) AS sclass,
         CAST(event_id % 12 AS INTEGER) AS priority,
         value / 1000 AS cpureq, value / 2000 AS ramreq, value / 4000 AS hdreq,
         CAST(0 AS INTEGER) AS "constraint",
         CAST(seq % 4 AS INTEGER) AS pos
  FROM adapter_ev
),
task_ev AS (
  SELECT "timestamp", missing, jobid, taskix, machineid, evtype, username, sclass, priority,
         cpureq, ramreq, hdreq, "constraint"
  FROM adapter_rows
),
job_ev AS (
  SELECT "timestamp", missing, jobid, evtype, username, sclass
  FROM adapter_rows WHERE NOT (taskix = 1 AND pos = 0)
)"""
