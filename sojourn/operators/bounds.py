"""Sojourn-time quantile bounds from sigma-rho envelopes, and the report.

tau1 = (ln eps - ln alpha - theta rhos) / (-theta) and
tauk = (ln eps - ln alpha - ln k - theta rhos) / (-theta) when rhoa > rhos,
else (0, 0). The report keeps, per user and mu, the envelope with the least
positive tau1 among those with a finite alpha (fixed values: eps 1e-6, k 16,
mu in 1.2, 1.4, 1.6, 2, 3, 4, 5, 6).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crossing as cr
from . import envelope as ev
from . import process as pr

EPS = 1.0e-6
K = 16
HEAVY_THRESHOLD = 10000
REF_MAX_L = 2000


def ieee_ln(x):
    """ln with IEEE results: -inf at 0, NaN below 0 (Spark gives NULL)."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


def tau_quantiles(env: DataFrame, eps: float = EPS, k: int = K) -> DataFrame:
    """``env`` plus tau1, tauk."""
    th, rhos = F.col("theta"), F.col("rhos")
    lead = F.lit(math.log(eps)) - ieee_ln(F.col("alpha"))
    t1 = (lead - th * rhos) / (-th)
    tk = (lead - F.lit(math.log(float(k))) - th * rhos) / (-th)
    ok = cr._gt(F.col("rhoa"), rhos)
    return env.select("*", F.when(ok, t1).otherwise(F.lit(0.0)).alias("tau1"),
                      F.when(ok, tk).otherwise(F.lit(0.0)).alias("tauk"))


def best_bounds(taus: DataFrame) -> DataFrame:
    """(username, mu, theta, tau1, tauk): least positive tau1 per (user, mu)
    over envelopes with a finite alpha; ties go to the earlier envelope."""
    finite = F.abs(F.col("alpha")) != F.lit(math.inf)
    keep = taus.where(finite & cr._gt(F.col("tau1"), F.lit(0.0)))
    best = keep.groupBy("username", "mu").agg(
        F.min(F.struct("tau1", "cand", "s_line", "a_line", "tauk", "theta")).alias("_b"))
    return best.select("username", "mu", F.col("_b.theta").alias("theta"),
                       F.col("_b.tau1").alias("tau1"), F.col("_b.tauk").alias("tauk"))


def bound_report(jobs: DataFrame, tasks: DataFrame, heavy_threshold: int = HEAVY_THRESHOLD,
                 mus: Sequence[float] = pr.DEFAULT_MUS, max_l: int = REF_MAX_L,
                 eps: float = EPS, k: int = K, semantics: str = "reference",
                 crossing_depth: int | None = None) -> DataFrame:
    """Per heavy user and mu: the best (tau1, tauk) bound.

    ``jobs``: job lifecycle with metadata and fail = 0; ``tasks``: task
    lifecycle with metadata. Crossing lags 1, max_l / 2, max_l.
    """
    from ..functions.ordering import materialize
    from .users import heavy_users

    # each is read several times: evaluated once here, as narrow as the report needs it
    jobs = materialize(jobs.select("username", "jobid", "arrive"))
    users = materialize(heavy_users(jobs, heavy_threshold))
    tasks = materialize(tasks.select("username", "jobid", "taskix", "arrive", "size").join(users, "username", "left_semi"))
    ap, ast = pr.arrival_process(jobs, users)
    sp, sst = pr.service_process(tasks, users)
    lags = (1, max_l // 2, max_l)
    cross = cr.crossing_theta(ap, ast, sp, sst, lags, mus, depth=crossing_depth or cr.DEPTH)
    cands = ev.theta_candidates(cross, lags)
    curves = materialize(ev.candidate_curves(cands, ap, ast, sp, sst, max_l, semantics))
    env = ev.envelope_fit(curves, semantics)
    return best_bounds(tau_quantiles(env, eps, k))


def report_from_files(spark, task_paths, job_paths, **options) -> DataFrame:
    """``bound_report`` of task and job event logs given as CSV paths, globs or lists;
    ``options`` as there."""
    from ..sources import csv_events
    from . import metadata as md

    once = csv_events.read_once
    jobs = md.job_lifecycle_meta(once(spark, csv_events.read_job_events, job_paths)).where("fail = 0")
    tasks = md.task_lifecycle_meta(once(spark, csv_events.read_task_events, task_paths))
    return bound_report(jobs, tasks, **options)
