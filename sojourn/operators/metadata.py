"""Attach submit-time metadata (user, class, requests) to lifecycle rows.

An inner equi-join with the SUBMIT events of the same key. A key submitted
twice yields two rows (one per SUBMIT), as in the analyzed code; pass
``dedupe_submits=True`` to keep only the latest SUBMIT per key instead.

The lifecycle side is already hash-partitioned on the key by its fold, so
the planner only shuffles the (filtered, pruned) SUBMIT side; AQE turns the
join into a broadcast at run time when one side turns out small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import JOB_META, SUBMIT, TASK_META
from .lifecycle import LIFECYCLE_NAMES, job_lifecycle, task_lifecycle


def _submits(events: DataFrame, keys: list[str], meta: list[str], dedupe: bool) -> DataFrame:
    sub = events.where(F.col("evtype") == SUBMIT)
    if not dedupe:
        return sub.select(*keys, *meta)
    last = F.max_by(F.struct(*[F.col(m) for m in meta]), F.col("timestamp"))
    return sub.groupBy(*keys).agg(last.alias("_m")).select(*keys, *[F.col(f"_m.{m}").alias(m) for m in meta])


def task_lifecycle_meta(task_events: DataFrame, dedupe_submits: bool = False) -> DataFrame:
    """19 columns: task lifecycle + machineid, username, sclass, priority, cpureq, ramreq, hdreq."""
    keys = ["jobid", "taskix"]
    tasks = task_lifecycle(task_events)
    return tasks.join(_submits(task_events, keys, TASK_META, dedupe_submits), keys).select(
        *keys, *LIFECYCLE_NAMES, "size", "waittime", *TASK_META
    )


def job_lifecycle_meta(job_events: DataFrame, dedupe_submits: bool = False) -> DataFrame:
    """13 columns: job lifecycle + username, sclass."""
    jobs = job_lifecycle(job_events)
    return jobs.join(_submits(job_events, ["jobid"], JOB_META, dedupe_submits), ["jobid"]).select(
        "jobid", *LIFECYCLE_NAMES, "size", "waittime", *JOB_META
    )


def join_task_metadata(tasks: DataFrame, task_events: DataFrame) -> DataFrame:
    """Stand-alone task metadata join: 15 columns (no evict/kill/lost/generalfailure)."""
    keys = ["jobid", "taskix"]
    return tasks.join(_submits(task_events, keys, TASK_META, False), keys).select(
        *keys, "arrive", "schedule", "finish", "fail", "size", "waittime", *TASK_META
    )


def join_job_metadata(jobs: DataFrame, job_events: DataFrame) -> DataFrame:
    """Stand-alone job metadata join for jobs that never failed (fail = 0).

    12 columns: jobid, arrive, schedule, evict, fail, kill, lost,
    generalfailure, size, waittime, username, sclass (no finish; ``fail``
    once).
    """
    ok = jobs.where(F.col("fail") == 0)
    return ok.join(_submits(job_events, ["jobid"], JOB_META, False), ["jobid"]).select(
        "jobid", "arrive", "schedule", "evict", "fail", "kill", "lost", "generalfailure",
        "size", "waittime", *JOB_META
    )
