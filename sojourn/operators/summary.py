"""Trace summary: table profile (row counts) and an equal-width histogram.

The histogram has ``buckets`` equal-width buckets over [min, max] of the
value, the last one closed; a constant column gives one bucket. The input is read once, for a
table of (value, count), written; min and max (scalar subqueries) and the bucket counts come
from that table. Empty buckets are filled from a ``range(buckets)`` frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from ..sources.schema import SUBMIT
from .lifecycle import event_type_counts, job_lifecycle, task_lifecycle
from .metadata import job_lifecycle_meta, task_lifecycle_meta


def histogram(df: DataFrame, col: str, buckets: int = 5) -> DataFrame:
    """(bucket int, lo double, hi double, count bigint), buckets 0..n-1."""
    spark = df.sparkSession
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    v = materialize(v.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    lo = v.agg(F.min("v")).scalar()
    hi = v.agg(F.max("v")).scalar()
    span = hi - lo
    nb = F.when(span == 0, F.lit(1)).otherwise(F.lit(buckets))
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - lo) / span * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))
    )
    counts = v.groupBy(b.alias("bucket")).agg(F.sum("n").alias("count"))
    width = span / F.lit(float(buckets))
    grid = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket") < nb)
    return grid.join(counts, "bucket", "left").select(
        "bucket",
        (lo + F.col("bucket") * width).alias("lo"),
        F.when(F.col("bucket") == nb - 1, hi).otherwise(lo + (F.col("bucket") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"),
    )


def _counts(events: DataFrame, lifecycle, keys: list[str], what: str) -> DataFrame:
    """Row counts of an event table, its lifecycle and the join with metadata, from one
    aggregate per key: a lifecycle row joins every SUBMIT of its key."""
    per_key = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("evtype") == SUBMIT, 1)).alias("submits"))
    valid = lifecycle(events).select(*keys, F.lit(1).alias("valid"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    joined = per_key.alias("p").join(valid.alias("v"), same, "left")
    known = joined.select("n", "valid", F.when(reduce(lambda a, b: a & b, [F.col(f"p.{k}").isNotNull() for k in keys]),
                                               F.col("submits")).otherwise(0).alias("submits"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("valid").alias("valid"),
                      F.coalesce(F.sum(F.col("valid") * F.col("submits")), F.lit(0)).alias("meta"))
    names = ((f"{what}_events", "events"), (f"{what}_lifecycle", "valid"), (f"{what}_lifecycle_meta", "meta"))
    return total.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("rows")) for n, c in names)))
                        .alias("x")).select("x.name", "x.rows")


def trace_profile(task_events: DataFrame, job_events: DataFrame) -> DataFrame:
    """(name, rows): row counts of the inputs and of each derived table. Two scans of
    each event table (its keys, and its lifecycle fold), no metadata is read."""
    return _counts(task_events, task_lifecycle, ["jobid", "taskix"], "task").unionByName(
        _counts(job_events, job_lifecycle, ["jobid"], "job"))


def trace_summary(spark: SparkSession, task_events: DataFrame, job_events: DataFrame) -> dict[str, DataFrame]:
    """Everything the trace summary reports, as DataFrames (nothing printed)."""
    tasks = task_lifecycle_meta(task_events)
    return {
        "profile": trace_profile(task_events, job_events),
        "task_event_counts": event_type_counts(task_events),
        "job_event_counts": event_type_counts(job_events),
        "tasks": tasks,
        "jobs": job_lifecycle_meta(job_events),
        "size_histogram": histogram(tasks, "size", 5),
    }


def summary_from_files(spark: SparkSession, task_paths, job_paths) -> dict[str, DataFrame]:
    """``trace_summary`` of task and job event logs given as CSV paths, globs or lists, each read
    once."""
    from ..sources import csv_events as ce

    return trace_summary(spark, ce.read_once(spark, ce.read_task_events, task_paths), ce.read_once(spark, ce.read_job_events, job_paths))
