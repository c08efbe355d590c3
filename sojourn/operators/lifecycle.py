"""Fold task / job events into one lifecycle row per task / job.

Per key, each lifecycle column keeps the latest timestamp of its event codes
(0 when there is none: a timestamp of 0 therefore counts as "no event").
Rows must have arrived, be scheduled after arrival (or not at all) and finish
after scheduling (or not at all). ``size`` = finish - schedule when
schedule <= finish else -1; ``waittime`` = schedule - arrive when
schedule >= arrive else -1. A task never scheduled nor finished has size 0;
one finished but never scheduled has size = finish.

The fold is a single hash aggregate with map-side partial maxima, so a job
with very many events costs one partial row per map task, not one hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import LIFECYCLE_COLUMNS

LIFECYCLE_NAMES = [name for name, _ in LIFECYCLE_COLUMNS]


def event_type_counts(events: DataFrame) -> DataFrame:
    """(evtype, count): how many events of each type."""
    return events.groupBy("evtype").agg(F.count(F.lit(1)).alias("count"))


def _pivot(codes) -> F.Column:
    cond = F.col("evtype") == codes[0] if len(codes) == 1 else F.col("evtype").isin(*codes)
    return F.when(cond, F.col("timestamp")).otherwise(F.lit(0).cast("long"))


def fold_lifecycle(events: DataFrame, keys: list[str]) -> DataFrame:
    """Lifecycle rows for ``keys`` (["jobid", "taskix"] or ["jobid"])."""
    folded = events.groupBy(*keys).agg(
        *[F.max(_pivot(codes)).alias(name) for name, codes in LIFECYCLE_COLUMNS]
    )
    arrive, schedule, finish = F.col("arrive"), F.col("schedule"), F.col("finish")
    valid = (arrive > 0) & ((schedule == 0) | (arrive < schedule)) & ((finish == 0) | (schedule < finish))
    return folded.where(valid).select(
        *keys,
        *LIFECYCLE_NAMES,
        F.when(schedule <= finish, finish - schedule).otherwise(F.lit(-1).cast("long")).alias("size"),
        F.when(schedule >= arrive, schedule - arrive).otherwise(F.lit(-1).cast("long")).alias("waittime"),
    )


def task_lifecycle(task_events: DataFrame) -> DataFrame:
    """12 columns: jobid, taskix, arrive .. generalfailure, size, waittime."""
    return fold_lifecycle(task_events, ["jobid", "taskix"])


def job_lifecycle(job_events: DataFrame) -> DataFrame:
    """11 columns: jobid, arrive .. generalfailure, size, waittime."""
    return fold_lifecycle(job_events, ["jobid"])
