"""Is log-MGF linear in the lag? Two tests over a theta grid, per user.

Fixed values: the grid is 0.5, then 0.9**i and 1 - 0.5**i for i = 2 .. 10
(19 thetas), negated for arrivals; max lag 2000; sliding fit window 25 % of
max lag.

r2:   least-squares fit of the whole valid curve; 0.0 when it has <= 10 lags.
span: slope of a fit over every window of w lags (window starts 0 ..
      len-w-1), min and max slope, and atan(max) - atan(min);
      (0, 0, 0) when the curve has fewer than w + 10 lags.
r2 is a ``regr_r2`` aggregate. The sliding fits come from prefix moments: running sums of x, y,
xy and x^2, centred per curve, whose difference at a window's ends gives its slope. One curve (at
most max_l rows) is one window partition, read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mgf import mgf_curves

REF_MAX_L = 2000
FIT_FRACTION = 0.25


def theta_grid(arrival: bool = False, factor: float = 0.9, count: int = 10) -> list[float]:
    """0.5, factor**i and 1 - 0.5**i (i = 2..count), sorted; negated for arrivals."""
    ts = [0.5]
    for i in range(2, count + 1):
        ts += [factor ** i, 1.0 - 0.5 ** i]
    ts.sort()
    return [-t for t in ts] if arrival else ts


def _curves(proc, stats, kind, max_l, semantics, curves):
    if curves is not None:
        return curves
    return mgf_curves(proc, stats, theta_grid(kind == "arrival"), kind=kind, max_l=max_l, semantics=semantics)


def linearity_r2(proc: DataFrame, stats: DataFrame, kind: str, max_l: int = REF_MAX_L,
                 semantics: str = "reference", curves: DataFrame | None = None) -> DataFrame:
    """(username, tkey, theta, r2)."""
    c = _curves(proc, stats, kind, max_l, semantics, curves)
    agg = c.groupBy("username", "tkey", "theta").agg(
        F.count(F.lit(1)).alias("_len"), F.regr_r2(F.col("logmgf"), F.col("lag").cast("double")).alias("_r2")
    )
    return agg.select("username", "tkey", "theta",
                      F.when(F.col("_len") <= 10, F.lit(0.0)).otherwise(F.col("_r2")).alias("r2"))


def linearity_span(proc: DataFrame, stats: DataFrame, kind: str, max_l: int = REF_MAX_L,
                   semantics: str = "reference", curves: DataFrame | None = None,
                   fit_fraction: float = FIT_FRACTION) -> DataFrame:
    """(username, tkey, theta, min_b, max_b, angle)."""
    w = int(fit_fraction * max_l)
    c = _curves(proc, stats, kind, max_l, semantics, curves)
    part = Window.partitionBy("username", "tkey")
    ordered = part.orderBy("lag")
    x, y = F.col("lag").cast("double"), F.col("logmgf")
    s = c.select("username", "tkey", "theta", "lag", F.count(F.lit(1)).over(part).alias("_len"),
                 (F.row_number().over(ordered) - 1).alias("_pos"),
                 (x - F.avg(x).over(part)).alias("_x"), (y - F.avg(y).over(part)).alias("_y"))
    moments = {"_sx": F.col("_x"), "_sy": F.col("_y"), "_sxy": F.col("_x") * F.col("_y"), "_sxx": F.col("_x") * F.col("_x")}
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("username", "tkey", "theta", "lag", "_len", "_pos", *(F.sum(v).over(upto).alias(k) for k, v in moments.items()))
    s = s.select("username", "tkey", "theta", "_len", "_pos",
                 *((F.col(k) - F.lag(k, w, 0.0).over(ordered)).alias(k) for k in moments))  # of the window that ends here
    s = s.withColumn("_b", F.expr(f"try_divide({w} * _sxy - _sx * _sy, {w} * _sxx - _sx * _sx)"))
    full = (F.col("_pos") >= w - 1) & (F.col("_pos") < F.col("_len") - 1)
    agg = s.groupBy("username", "tkey", "theta").agg(
        F.max("_len").alias("_len"),
        F.min(F.when(full, F.col("_b"))).alias("_min"),
        F.max(F.when(full, F.col("_b"))).alias("_max"),
    )
    short = F.col("_len") < w + 10
    mn = F.when(short, F.lit(0.0)).otherwise(F.col("_min"))
    mx = F.when(short, F.lit(0.0)).otherwise(F.col("_max"))
    return agg.select("username", "tkey", "theta", mn.alias("min_b"), mx.alias("max_b"),
                      (F.atan(mx) - F.atan(mn)).alias("angle"))
