"""One place that lists every registered query and its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracle, queries as q


def queries() -> dict:
    out = {}
    out.update(q.lifecycle_queries())
    out.update(q.summary_queries())
    out.update(q.process_queries())
    out.update(q.lagsum_queries())
    out.update(q.linearity_queries())
    out.update(q.crossing_queries())
    out.update(q.envelope_queries())
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    out.update(oracle.lifecycle_sql())
    out.update(oracle.summary_sql())
    out.update(oracle.process_sql())
    out.update(oracle.lagsum_sql())
    out.update(oracle.linearity_sql())
    out.update(oracle.crossing_sql())
    out.update(oracle.envelope_sql())
    return out


def flagship(spark: SparkSession, sf_dir: str, heavy: int = 10, max_l: int = 16) -> DataFrame:
    """Bound report (per heavy user and mu: theta, tau1, tauk) with parameters
    sized for the smallest test tables (users with > 10 jobs, max lag 16:
    the envelope fit needs at least 10 valid lags)."""
    from pyspark.sql import functions as F

    from ..operators import bounds as bd

    jobs, tasks, _ = q.analysis_inputs(spark, sf_dir, heavy)
    r = bd.bound_report(jobs, tasks, heavy_threshold=heavy, max_l=max_l)
    return r.select("username", "mu", F.round("theta", q.R6).alias("theta"), F.round("tau1", q.R6).alias("tau1"),
                    F.round("tauk", q.R6).alias("tauk"))
