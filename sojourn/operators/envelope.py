"""Sigma-rho envelopes of the arrival and service MGF curves.

Candidates (per user and mu): the crossing thetas at lags 1, max_l/2 and
max_l, and each of them times 0.98**i, i = 1..10 (33 values).

Fit (per user, mu and candidate theta), with the arrival curve fA (theta
negated) and the service curve fS on array positions p = lag - 1, and n the
shorter length (no rows when n < 10):
  lwin = n div 10; slopes (f(p + lwin) - f(p)) / lwin for p < n - lwin give
  min/max rhoA and rhoS (running maxima start at 0); min rhoA is raised to
  min rhoS; no rows when min > max.
  rhoS = minS + (maxS - minS) * s/10, s = 0..9;  rhoA = minA + (maxA - minA) * a/10, a = 1..10
  reference:  sigmaS = max_p (fS(p) - p rhoS) - rhoS   (whole service curve)
              sigmaA = max_{p<n} (p rhoS - fS(p))       (reads the service curve)
              stored rho_s = minS
  documented: sigmaS = max_lag (fS - (lag + 1) rhoS),  sigmaA = max_lag (lag rhoA - fA),
              stored rho_s = rhoS
  alpha = exp(theta (sigmaA + sigmaS)) / (1 - exp(-theta (rhoA - rhoS)))  (IEEE on x/0).
A sigma is the Legendre transform of a curve at a rho: the largest f(p) - p rho lies on the
upper hull of the points (p, f(p)), the least on the lower hull. Each candidate's two curves
(at most max_l points each) are one row of arrays; their hulls are taken once and every rho of the grid
finds its point there by binary search among the hull's slopes. No row is made of a lag and a line.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mgf import mgf_curves

CAND_FACTOR = 0.98
CAND_STEPS = 10
NUM_LINES = 10

INF = float("inf")


def ieee_div(num, den):
    """num / den with IEEE results for den = 0 (ANSI mode would raise)."""
    return F.when(den == 0, F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF)).otherwise(F.lit(float("nan")))
                  ).otherwise(num / den)


def theta_candidates(crossings: DataFrame, lags: Sequence[int]) -> DataFrame:
    """(username, mu, cand, theta): 3 crossing thetas and their 0.98**i multiples.

    ``crossings`` is the output of ``crossing_theta`` at exactly three lags.
    cand = 3 * i + j for lag position j and factor 0.98**i.
    """
    lags = [int(x) for x in lags]
    pos = F.when(F.col("l") == lags[0], 0).when(F.col("l") == lags[1], 1).otherwise(2)
    c = crossings.where(F.col("l").isin(*lags)).select("username", "mu", pos.alias("j"), "theta")
    i = F.explode(F.sequence(F.lit(0), F.lit(CAND_STEPS))).alias("i")
    c = c.select("username", "mu", "j", "theta", i)
    factor = F.when(F.col("i") == 0, F.lit(1.0)).otherwise(F.pow(F.lit(CAND_FACTOR), F.col("i").cast("double")))
    return c.select("username", "mu", (F.col("i") * 3 + F.col("j")).cast("int").alias("cand"),
                    F.when(F.col("i") == 0, F.col("theta")).otherwise(factor * F.col("theta")).alias("theta"))


def _tkey():
    return (F.round(F.col("mu") * 1_000_000).cast("long") * 1000 + F.col("cand")).alias("tkey")


def candidate_curves(cands: DataFrame, arr_proc: DataFrame, arr_stats: DataFrame, svc_proc: DataFrame,
                     svc_stats: DataFrame, max_l: int, semantics: str = "reference",
                     method: str = "kernel") -> DataFrame:
    """(username, mu, cand, theta, kind, p, f): both log-MGF curves per candidate."""
    keyed = cands.select("username", "mu", "cand", "theta", _tkey())
    ta = keyed.join(arr_stats.select("username", "c"), "username").select("username", "tkey", "theta", "c")
    ts = keyed.join(svc_stats.select("username", "mean_raw"), "username").select(
        "username", "tkey", "theta", (F.col("mu") * F.col("mean_raw")).alias("c"))
    ca = mgf_curves(arr_proc, arr_stats, ta, kind="arrival", max_l=max_l, semantics=semantics, method=method)
    cs = mgf_curves(svc_proc, svc_stats, ts, kind="service", max_l=max_l, semantics=semantics, method=method)
    both = ca.select("username", "tkey", F.lit("A").alias("kind"), "lag", "logmgf").unionByName(
        cs.select("username", "tkey", F.lit("S").alias("kind"), "lag", "logmgf"))
    return both.join(keyed, ["username", "tkey"]).select(
        "username", "mu", "cand", "theta", "kind", (F.col("lag") - 1).alias("p"), F.col("logmgf").alias("f"))


def upper_hull(f: np.ndarray) -> np.ndarray:
    """Positions of the vertices of the upper hull of the points (p, f[p])."""
    hull: list[int] = []
    y = f.tolist()
    for p, v in enumerate(y):
        while len(hull) > 1 and (y[hull[-1]] - y[hull[-2]]) * (p - hull[-1]) <= (v - y[hull[-1]]) * (hull[-1] - hull[-2]):
            hull.pop()
        hull.append(p)
    return np.array(hull)


def highest(f: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """For each rho the position p with the largest f[p] - p rho."""
    hull = upper_hull(f)
    slopes = np.diff(f[hull]) / np.diff(hull)  # falling
    at = np.searchsorted(-slopes, -np.asarray(rho, dtype=np.float64))
    near = np.clip(at[:, None] + np.arange(-1, 2), 0, len(hull) - 1)  # rounding may move a tie by one vertex
    value = f[hull[near]] - hull[near] * np.asarray(rho)[:, None]
    return hull[near[np.arange(len(at)), value.argmax(axis=1)]]


LINES = "s_line int, a_line int, sigmaa double, rhoa double, sigmas double, rhos double"


def lines_of(fa: np.ndarray, fs: np.ndarray, semantics: str) -> dict[str, np.ndarray] | None:
    """The 100 lines of one candidate, s_line by a_line; None where there is no envelope."""
    n = min(len(fa), len(fs))
    if n < 10:
        return None
    lwin = n // 10
    slope = lambda f: (f[lwin:n] - f[:n - lwin]) / lwin
    sa, ss = slope(fa), slope(fs)
    min_s, max_s = min(1.0e99, ss.min()), max(0.0, ss.max())
    min_a, max_a = max(min(1.0e99, sa.min()), min_s), max(0.0, sa.max())
    if min_a > max_a or min_s > max_s:
        return None
    rhos = min_s + (max_s - min_s) * (np.arange(NUM_LINES) / float(NUM_LINES))
    rhoa = min_a + (max_a - min_a) * (np.arange(1, NUM_LINES + 1) / float(NUM_LINES))
    p = highest(fs, rhos)
    if semantics == "reference":
        sigmas = fs[p] - p * rhos - rhos
        p = highest(-fs[:n], -rhos)
        sigmaa = np.repeat(p * rhos - fs[p], NUM_LINES)
        stored = np.full(NUM_LINES, min_s)
    else:
        sigmas = fs[p] - (p + 2) * rhos
        p = highest(-fa, -rhoa)
        sigmaa = np.tile((p + 1) * rhoa - fa[p], NUM_LINES)
        stored = rhos
    each = lambda x: np.repeat(x, NUM_LINES)
    return {"s_line": each(np.arange(NUM_LINES)), "a_line": np.tile(np.arange(1, NUM_LINES + 1), NUM_LINES), "sigmaa": sigmaa,
            "rhoa": np.tile(rhoa, NUM_LINES), "sigmas": each(sigmas), "rhos": each(stored), "line_rhos": each(rhos)}


def envelope_fit(curves: DataFrame, semantics: str = "reference") -> DataFrame:
    """(username, mu, cand, s_line, a_line, sigmaa, rhoa, sigmas, rhos, theta, alpha)."""
    if semantics not in ("reference", "documented"):
        raise ValueError(semantics)
    key = ["username", "mu", "cand"]
    points = lambda kind: F.transform(F.array_sort(F.collect_list(  # noqa: E731  at most max_l of a curve
        F.when(F.col("kind") == kind, F.struct("p", "f")))), lambda x: x["f"]).alias(f"f{kind.lower()}")
    whole = curves.groupBy(*key, "theta").agg(points("A"), points("S"))

    names = ["username", "mu", "cand", "theta", *(c.split()[0] for c in LINES.split(", ")), "line_rhos"]

    def run(batches):
        for pdf in batches:
            found = [lines_of(np.asarray(fa, dtype=np.float64), np.asarray(fs, dtype=np.float64), semantics)
                     for fa, fs in zip(pdf["fa"], pdf["fs"])]
            at = [k for k, lines in enumerate(found) if lines is not None]
            if at:
                own = pdf.iloc[np.repeat(at, NUM_LINES * NUM_LINES)]
                lines = {c: np.concatenate([found[k][c] for k in at]) for c in names[4:]}
                yield pd.DataFrame({**{c: own[c].to_numpy() for c in names[:4]}, **lines})

    env = whole.mapInPandas(run, f"username string, mu double, cand int, theta double, {LINES}, line_rhos double")
    th = F.col("theta")
    alpha = ieee_div(F.exp(th * (F.col("sigmaa") + F.col("sigmas"))),
                     F.lit(1.0) - F.exp(-th * (F.col("rhoa") - F.col("line_rhos"))))
    return env.select(*key, "s_line", "a_line", "sigmaa", "rhoa", "sigmas", "rhos", "theta", alpha.alias("alpha"))
