"""Seeded i.i.d. exponential process, to test the MGF algorithms.

x = -ln(1 - u) / rate with u uniform in [0, 1) (``F.rand(seed)``), raw =
floor(x * 1e12), so x is recovered as raw / 1e12 (scale c = 1e12). The
result has the process-frame layout (username, idx, raw, x, pre) and a
stats frame (username, n, c, r0, mean_raw), for one or more synthetic users.
Rows are generated by ``spark.range`` (distributed); positions come from the
range id, prefix sums from ``ordered_index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import ordered_index

RAW_SCALE = 1.0e12


def exponential_process(spark: SparkSession, rate: float, num: int, seed: int = 42,
                        users: int = 1, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``users`` independent processes of ``num`` increments each."""
    base = spark.range(0, num * users, numPartitions=partitions or spark.sparkContext.defaultParallelism)
    u = F.rand(seed)
    x = -F.log(F.lit(1.0) - u) / F.lit(float(rate))
    df = base.select(
        F.concat(F.lit("exp"), (F.col("id") % users).cast("string")).alias("username"),
        (F.col("id") / users).cast("long").alias("k"),
        F.floor(x * F.lit(RAW_SCALE)).cast("long").alias("raw"),
    )
    df = ordered_index(df, ["username"], ["k"], idx_col="idx", sum_col="raw", prefix_col="pre")
    proc = df.select("username", "idx", "raw", (F.col("raw") / F.lit(RAW_SCALE)).alias("x"), "pre")
    stats = proc.groupBy("username").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("raw", "idx").alias("r0"), F.avg("raw").alias("mean_raw"),
    ).select("username", "n", F.lit(RAW_SCALE).alias("c"), "r0", "mean_raw")
    return proc, stats
