"""Per-user point processes, for all (heavy) users at once.

Process frames have columns (username, idx, raw, x, pre):
  idx  0-based position in time order,
  raw  integer increment (inter-arrival time, or service size),
  x    raw / c, the normalized increment,
  pre  sum of raw over positions < idx (exact integer prefix sum),
and a companion per-user frame (username, n, c, r0, mean_raw).

Arrivals: job arrivals sorted by (arrive, jobid), increment = arrive minus
the previous arrive; the first row (relative to time 0) is dropped;
c = lambda * ((sum of increments) div n)  -- integer-truncated mean.
Services: per job the lowest task index with size >= 0; sizes in order of
that task's (arrive, jobid); c = mu * ((sum of sizes) div n).
Renormalized services: c = mu * exact mean, so the mean of x is 1 / mu.

No whole user goes through one task or the driver: positions and prefix sums
come from ``ordered_index`` (block-wise), per-user constants from grouped
aggregates joined back by user.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import DEFAULT_BLOCK_ROWS, materialize, ordered_index

DEFAULT_MUS = (1.2, 1.4, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0)


def _only(df: DataFrame, users: DataFrame | None) -> DataFrame:
    if users is None:
        return df
    return df.join(users.select("username"), "username", "left_semi")


def arrival_increments(jobs: DataFrame, users: DataFrame | None = None,
                       block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(username, idx, raw, pre, arrive): inter-arrival times, first dropped."""
    a = _only(jobs, users).select("username", "jobid", "arrive")
    a = ordered_index(a, ["username"], ["arrive", "jobid"], idx_col="k",
                      prev_of="arrive", prev_col="prev", first_of="arrive", first_col="_a0",
                      block_rows=block_rows)
    return a.where(F.col("k") >= 1).select(
        "username",
        (F.col("k") - 1).alias("idx"),
        (F.col("arrive") - F.col("prev")).alias("raw"),
        (F.col("prev") - F.col("_a0")).alias("pre"),
        "arrive",
    )


def _with_scale(inc: DataFrame, scale: float, exact_mean: bool) -> tuple[DataFrame, DataFrame]:
    """``inc`` comes from ``ordered_index``, which has written it. The constants (one row a user) are
    written too: evaluated once, however many frames join them, and of known size, so that while
    they are small a join with them moves no row of the process."""
    st = inc.groupBy("username").agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw").alias("_s"),
        F.max_by("raw", "idx").alias("_last"), F.min_by("raw", "idx").alias("r0"),
    )
    if exact_mean:
        c = F.lit(scale) * (F.col("_s") / F.col("n"))
    else:
        c = F.lit(scale) * F.expr("_s div n").cast("double")
    st = materialize(st.select("username", "n", c.alias("c"), "r0", (F.col("_s") / F.col("n")).alias("mean_raw")))
    proc = inc.join(st.select("username", "c"), "username").select(
        "username", "idx", "raw", F.expr("try_divide(raw, c)").alias("x"), "pre"
    )
    return proc, _scaled(st)


def _scaled(stats: DataFrame) -> DataFrame:
    """Users whose process has a scale: one with only zero increments (c = 0) has
    no normalized process, hence no curve, search or bound."""
    return stats.where(F.col("c") > 0)


def arrival_process(jobs: DataFrame, users: DataFrame | None = None, lam: float = 1.0,
                    block_rows: int | None = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Normalized inter-arrival process of each user's jobs."""
    inc = arrival_increments(jobs, users, block_rows).drop("arrive")
    return _with_scale(inc, lam, exact_mean=False)


def first_task_services(tasks: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(username, jobid, arrive, size) of the lowest-index finished task per job.

    A grouped min over struct(taskix, ...) (partial-aggregated: a job with
    very many tasks is not a hot window partition).
    """
    t = _only(tasks, users).where(F.col("size") >= 0)
    first = t.groupBy("username", "jobid").agg(F.min(F.struct("taskix", "arrive", "size")).alias("_m"))
    return first.select("username", "jobid", F.col("_m.arrive").alias("arrive"), F.col("_m.size").alias("size"))


def service_increments(tasks: DataFrame, users: DataFrame | None = None,
                       block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    s = first_task_services(tasks, users)
    s = ordered_index(s, ["username"], ["arrive", "jobid"], idx_col="idx", sum_col="size",
                      prefix_col="pre", block_rows=block_rows)
    return s.select("username", "idx", F.col("size").alias("raw"), "pre")


def service_process(tasks: DataFrame, users: DataFrame | None = None, mu: float = 1.0,
                    block_rows: int | None = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Service process as loaded (truncated-mean normalization)."""
    return _with_scale(service_increments(tasks, users, block_rows), mu, exact_mean=False)


def renormalized_services(services: DataFrame, mus: Sequence[float] = DEFAULT_MUS) -> DataFrame:
    """(username, mu, idx, raw, x): services rescaled to mean 1/mu, for every mu.

    ``services`` is a service process frame (username, idx, raw, ...). The
    mu list is a literal array exploded per row: no join, no shuffle.
    """
    st = services.groupBy("username").agg((F.sum("raw") / F.count(F.lit(1))).alias("_m"))
    mu = F.explode(F.array(*[F.lit(float(m)) for m in mus])).alias("mu")
    s = services.join(st, "username").select("username", mu, "idx", "raw", "_m")
    return s.select("username", "mu", "idx", "raw", F.expr("try_divide(raw, mu * _m)").alias("x"))


def normalized_arrivals(jobs: DataFrame, users: DataFrame | None = None, lam: float = 1.0,
                        block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(username, arrive, interarrival, interarrivalN).

    Drops every row tied with the user's first arrival (not just one row);
    normalizes by the exact mean inter-arrival.
    """
    inc = arrival_increments(jobs, users, block_rows)
    kept = inc.where(F.col("arrive") > F.col("arrive") - F.col("raw") - F.col("pre"))
    mean = kept.groupBy("username").agg(F.avg("raw").alias("_m"))
    return kept.join(mean, "username").select(
        "username", "arrive", F.col("raw").alias("interarrival"),
        F.try_divide(F.col("raw"), F.lit(float(lam)) * F.col("_m")).alias("interarrivalN"),
    )


def normalized_services(tasks: DataFrame, users: DataFrame | None = None, mu: float = 1.0) -> DataFrame:
    """(username, arrive, size, sizeN) of task 0 of jobs with fail = 0."""
    t = _only(tasks, users).where((F.col("fail") == 0) & (F.col("taskix") == 0))
    mean = t.groupBy("username").agg(F.avg("size").alias("_m"))
    return t.join(mean, "username").select(
        "username", "arrive", "size", F.try_divide(F.col("size"), F.lit(float(mu)) * F.col("_m")).alias("sizeN")
    )


def task_interarrivals(tasks: DataFrame, users: DataFrame | None = None,
                       block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(username, idx, interarrival): differences of consecutive task arrivals."""
    t = _only(tasks, users).select("username", "jobid", "taskix", "arrive")
    t = ordered_index(t, ["username"], ["arrive", "jobid", "taskix"], idx_col="k",
                      prev_of="arrive", prev_col="prev", block_rows=block_rows)
    return t.where(F.col("k") >= 1).select(
        "username", (F.col("k") - 1).alias("idx"), (F.col("arrive") - F.col("prev")).alias("interarrival")
    )


def autocorrelation(series: DataFrame, value: str, max_lag: int = 100, block: int | None = None) -> DataFrame:
    """(username, lag, acf) for lag 1..max_lag (lags with no pair are absent).

    acf(k) = sum_t (x_t - m)(x_{t+k} - m) / sum_t (x_t - m)^2, m the user's
    mean. Positions are dealt to blocks with a halo of ``max_lag`` rows; each block
    gives one product sum per lag, all of them from one FFT correlation of its own rows with
    its rows and halo.
    """
    from .lagsums import BLOCK, halo_blocks

    block = max(int(block or BLOCK), max_lag)
    st = series.groupBy("username").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    c = series.join(st, "username").select("username", "idx", "_n", (F.col(value) - F.col("_m")).alias("y"))

    def run(key, rows):
        rows = rows.sort_values("idx")
        y, n = rows["y"].to_numpy(), int(rows["_n"].iloc[0])
        m = min((int(key[1]) + 1) * block, n) - int(rows["idx"].iloc[0])  # rows of this block itself
        lags = np.arange(min(max_lag + 1, len(y)), dtype=np.int32)
        size = 1 << int(m + len(y)).bit_length()  # long enough that nothing wraps around
        s = np.fft.irfft(np.conj(np.fft.rfft(y[:m], size)) * np.fft.rfft(y, size), size)[:len(lags)]
        return pd.DataFrame({"username": key[0], "lag": lags, "s": s})

    sums = halo_blocks(c, block, max_lag).groupBy("username", "blk").applyInPandas(
        run, "username string, lag int, s double").groupBy("username", "lag").agg(F.sum("s").alias("_s"))
    den = sums.where("lag = 0").select("username", F.col("_s").alias("_d"))
    return sums.where("lag > 0").join(den, "username").select("username", "lag", F.expr("try_divide(_s, _d)").alias("acf"))


def normalized_arrival_process(jobs: DataFrame, users: DataFrame | None = None, lam: float = 1.0,
                               block_rows: int | None = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Process frame of the normalized-arrivals form: increments after every
    row tied with the first arrival, scale c = lam * exact mean."""
    inc = arrival_increments(jobs, users, block_rows)
    kept = inc.where(F.col("arrive") > F.col("arrive") - F.col("raw") - F.col("pre"))
    first = kept.groupBy("username").agg(F.min("idx").alias("_i0"), F.min_by("pre", "idx").alias("_p0"))
    proc = materialize(kept.join(first, "username").select(
        "username", (F.col("idx") - F.col("_i0")).alias("idx"), "raw", (F.col("pre") - F.col("_p0")).alias("pre")))
    st = proc.groupBy("username").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"),
                                      F.min_by("raw", "idx").alias("r0"))
    st = materialize(st.select("username", "n", (F.lit(float(lam)) * F.col("mean_raw")).alias("c"), "r0", "mean_raw"))
    return proc.join(st.select("username", "c"), "username").select(
        "username", "idx", "raw", F.try_divide(F.col("raw"), F.col("c")).alias("x"), "pre"), _scaled(st)


def normalized_service_process(tasks: DataFrame, users: DataFrame | None = None, mu: float = 1.0,
                               block_rows: int | None = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Process frame of the normalized-services form: sizes of task 0 of jobs
    with fail = 0 in (arrive, jobid, taskix) order, c = mu * exact mean."""
    t = _only(tasks, users).where((F.col("fail") == 0) & (F.col("taskix") == 0))
    t = ordered_index(t.select("username", "jobid", "taskix", "arrive", "size"), ["username"],
                      ["arrive", "jobid", "taskix"], idx_col="idx", sum_col="size", prefix_col="pre",
                      block_rows=block_rows)
    proc = materialize(t.select("username", "idx", F.col("size").alias("raw"), "pre"))
    st = proc.groupBy("username").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"),
                                      F.min_by("raw", "idx").alias("r0"))
    st = materialize(st.select("username", "n", (F.lit(float(mu)) * F.col("mean_raw")).alias("c"), "r0", "mean_raw"))
    return proc.join(st.select("username", "c"), "username").select(
        "username", "idx", "raw", F.try_divide(F.col("raw"), F.col("c")).alias("x"), "pre"), _scaled(st)
