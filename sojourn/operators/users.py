"""Jobs per user and the heavy-user set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import DEFAULT_BLOCK_ROWS, ordered_index


def jobs_per_user(jobs: DataFrame) -> DataFrame:
    """(username, count)."""
    return jobs.groupBy("username").agg(F.count(F.lit(1)).alias("count"))


def heavy_users(jobs: DataFrame, threshold: int) -> DataFrame:
    """(username, count) of users with more than ``threshold`` job rows.

    ``jobs`` is normally the job lifecycle with metadata, restricted to
    fail = 0; with several SUBMITs per job each SUBMIT row counts.
    """
    return jobs_per_user(jobs).where(F.col("count") > F.lit(threshold))


def ranked_heavy_users(jobs: DataFrame, threshold: int, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(place, username, count): heavy users by falling count, place from 1 (ties:
    the smaller name first). One row per heavy user is ordered, not one per job, in range
    partitions; only their number of rows, one a partition, is read by one task."""
    users = heavy_users(jobs, threshold).withColumn("fall", -F.col("count"))
    ranked = ordered_index(users, [], ["fall", "username"], block_rows=block_rows)
    return ranked.select((F.col("idx") + 1).cast("int").alias("place"), "username", "count")
