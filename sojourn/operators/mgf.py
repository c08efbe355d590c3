"""Empirical moment generating function of lag sums, as curves over the lag.

For a process x = raw / c with prefix sums pre, a theta and a lag l, the
curve value is mgf(l) = mean_i exp(theta * X(i, l)) over a fixed start set
i = 0 .. M-1 and logmgf(l) = ln(mgf(l)) / theta.

``semantics="reference"`` (default) reproduces the analyzed code:
  arrival  M = n - max_l,     X = x[i] + ... + x[i+l]          (l+1 terms)
  service  M = n - max_l - 1, X = x[0] + x[i+1] + ... + x[i+l+1]
           (l+2 terms, with the constant first term x[0])
  lags min_l .. b-2, b the first lag whose mgf is 0 or infinite
  (min_l .. max_l-2 when there is none).
``semantics="documented"`` is what its comments describe:
  arrival  X = x[i] + ... + x[i+l-1] (l terms), service x[i] + ... + x[i+l]
  lags min_l .. b-1 (min_l .. max_l-1).
Theta signs are repaired as there: arrivals use -|theta|, services |theta|.

Two interchangeable plans:
  "kernel" (default): each user's starts are cut into blocks of B; every
     prefix row is sent to its own block and to the earlier block whose
     windows reach it (halo of max_l + 2 rows, so at most two blocks when
     B >= max_l + 2); a cogrouped pandas kernel evaluates all (theta, lag)
     partial sums of one block with NumPy; a plain groupBy adds the blocks.
     A user of any size spreads over n / B tasks; what is shuffled per block
     is thetas x lags partial sums, never the n x lags lag-sum matrix.
  "join": the same sums from a self equi-join on (username, idx + offset)
     and ``avg(exp(...))``; all built-in, for small lag ranges and checks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import compute_partitions

KERNEL_SCHEMA = "username string, tag int, tkey long, lag int, s double, cnt long"
DEFAULT_MGF_BLOCK = 32768
MIN_MGF_BLOCK = 8192


def theta_frame(stats: DataFrame, thetas) -> DataFrame:
    """(username, tkey, theta) for every user of ``stats``.

    ``thetas``: a list of floats (the same grid for every user, tkey = position)
    or a DataFrame (username, tkey, theta) already per user.
    """
    if isinstance(thetas, DataFrame):
        cols = ["username", F.col("tkey").cast("long").alias("tkey"), F.col("theta").cast("double")]
        if "c" in thetas.columns:
            cols.append(F.col("c").cast("double"))
        return thetas.select(*cols)
    grid = F.explode(F.arrays_zip(
        F.array(*[F.lit(i).cast("long") for i in range(len(thetas))]).alias("tkey"),
        F.array(*[F.lit(float(t)) for t in thetas]).alias("theta"),
    )).alias("_t")
    return stats.select("username", grid).select("username", "_t.tkey", "_t.theta")


def _signed(theta, kind: str):
    return -F.abs(theta) if kind == "arrival" else F.abs(theta)


def _offsets(kind: str, semantics: str):
    """(a, b, use_r0): X(i, l) = [r0] + pre[i + l + b] - pre[i + a]."""
    if semantics == "reference":
        return (0, 1, False) if kind == "arrival" else (1, 2, True)
    if semantics == "documented":
        return (0, 0, False) if kind == "arrival" else (0, 1, False)
    raise ValueError(f"unknown semantics {semantics!r}")


def _starts(kind: str, max_l: int) -> int:
    """M = n - starts_gap."""
    return max_l if kind == "arrival" else max_l + 1


def _kernel(kind: str, semantics: str, ranges: dict[int, tuple[int, int]], block: int):
    """Partial sums of one block: of every theta over the lags of its tag's range, and over the
    starts that this range allows."""
    a, b, use_r0 = _offsets(kind, semantics)
    none = pd.DataFrame({"username": pd.Series([], dtype=object), "tag": pd.Series([], dtype="int32"),
                         "tkey": pd.Series([], dtype="int64"), "lag": pd.Series([], dtype="int32"),
                         "s": pd.Series([], dtype="float64"), "cnt": pd.Series([], dtype="int64")})

    def run(key, rows: pd.DataFrame, ths: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or ths.empty:
            return none
        user, blk = key[0], int(key[1])
        rows = rows.sort_values("idx")
        base = int(rows["idx"].iloc[0])
        pre = rows["pre"].to_numpy(dtype=np.int64)
        raw = np.diff(pre).astype(np.float64)
        n = int(rows["n"].iloc[0])
        r0 = int(rows["r0"].iloc[0]) if use_r0 else 0
        out = []
        for tag, mine in ths.groupby("tag"):
            min_l, max_l = ranges[int(tag)]
            lo, hi = blk * block, min(blk * block + block, n - _starts(kind, max_l))
            if hi <= lo:
                continue
            st = np.arange(lo, hi, dtype=np.int64) - base
            coef = mine["theta"].to_numpy(dtype=np.float64) / mine["c"].to_numpy(dtype=np.float64)
            nt, lags = len(coef), list(range(min_l, max_l))
            sums = np.empty((len(lags), nt))
            first = (pre[st + min_l + b] - pre[st + a] + r0).astype(np.float64)
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                for t, k in enumerate(coef):
                    # exp once per row and theta; the next lag's terms are products with one more row
                    grow = np.exp(k * raw)
                    term = np.exp(k * first)
                    sums[0, t] = term.sum()
                    for j in range(1, len(lags)):
                        at = st[0] + lags[j] + b - 1
                        term *= grow[at:at + len(st)]
                        sums[j, t] = term.sum()
            out.append(pd.DataFrame({
                "username": user, "tag": np.int32(tag), "tkey": np.tile(mine["tkey"].to_numpy(dtype=np.int64), len(lags)),
                "lag": np.repeat(np.asarray(lags, dtype=np.int32), nt), "s": sums.reshape(-1), "cnt": np.int64(hi - lo)}))
        return pd.concat(out) if out else none

    return run


def kernel_plan(stats: DataFrame, kind: str, max_l: int, block: int | None = None) -> tuple[int, int]:
    """(starts per block, partitions) for the kernel. Blocks: about two per core over
    all starts, within [MIN_MGF_BLOCK, DEFAULT_MGF_BLOCK] and at least 4 halos (a row
    feeds at most two blocks). Partitions grow with the number of blocks."""
    m = F.col("n") - _starts(kind, max_l)
    total, users = stats.where(m >= 1).agg(F.sum(m), F.count(F.lit(1))).first()
    total, users = int(total or 0), int(users or 0)
    halo = max_l + 2
    if block is None:
        per = -(-total // (2 * stats.sparkSession.sparkContext.defaultParallelism))
        block = max(4 * halo, min(DEFAULT_MGF_BLOCK, max(MIN_MGF_BLOCK, per)))
    block = max(int(block), halo)
    return block, compute_partitions(stats.sparkSession, total // block + users)


def _partial_sums_kernel(proc, stats, th, kind, semantics, ranges, plan):
    halo = max(max_l for _, max_l in ranges.values()) + 2
    fewest = min(_starts(kind, max_l) for _, max_l in ranges.values())
    users = stats.select("username", (F.col("n") - fewest).alias("m"), "n", "r0").where(F.col("m") >= 1)
    block, n_parts = plan
    nb = F.ceil(F.col("m") / F.lit(block)).cast("long")
    k = F.col("idx")
    first_b = F.greatest(F.lit(0).cast("long"), F.ceil((k - block - halo + 1) / F.lit(block)).cast("long"))
    last_b = F.least(F.floor(k / F.lit(block)).cast("long"), nb - 1)
    rows = proc.select("username", "idx", "pre").join(users, "username").where(first_b <= last_b).select(
        "username", F.explode(F.sequence(first_b, last_b)).alias("blk"), "idx", "pre", "n", "r0"
    )
    blocks = users.select("username", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)).alias("blk"))
    # fresh key attributes on the theta side: both sides descend from ``stats``
    tb = blocks.join(th, "username").select(
        F.col("username").alias("_u"), F.col("blk").alias("_b"), "tag", "tkey", "theta", "c"
    )
    fn = _kernel(kind, semantics, ranges, block)
    # Each (user, block) group is small in bytes but heavy in work: an
    # explicit partition count keeps AQE from packing many groups per task.
    rows = rows.repartition(n_parts, "username", "blk")
    tb = tb.repartition(n_parts, "_u", "_b")
    part = rows.groupBy("username", "blk").cogroup(tb.groupBy("_u", "_b")).applyInPandas(fn, KERNEL_SCHEMA)
    return part.groupBy("username", "tag", "tkey", "lag").agg(F.sum("s").alias("s"), F.sum("cnt").alias("cnt"))


def _partial_sums_join(proc, stats, th, kind, semantics, min_l, max_l):
    a, b, use_r0 = _offsets(kind, semantics)
    gap = _starts(kind, max_l)
    users = stats.select("username", (F.col("n") - gap).alias("m"), "r0").where(F.col("m") >= 1)
    lag = F.explode(F.sequence(F.lit(min_l), F.lit(max_l - 1))).alias("lag")
    left = proc.select("username", (F.col("idx") - a).alias("i"), F.col("pre").alias("p0")).join(users, "username")
    left = left.where((F.col("i") >= 0) & (F.col("i") < F.col("m"))).select("username", "i", "p0", "r0", lag)
    left = left.select("username", "lag", "p0", "r0", (F.col("i") + F.col("lag") + b).alias("idx"))
    right = proc.select("username", "idx", F.col("pre").alias("p1"))
    pairs = left.join(right, ["username", "idx"]).select(
        "username", "lag", (F.col("p1") - F.col("p0") + (F.col("r0") if use_r0 else F.lit(0))).alias("x")
    )
    e = pairs.join(th, "username")
    agg = e.groupBy("username", "tkey", "lag").agg(
        F.sum(F.exp(F.try_divide(F.col("theta"), F.col("c")) * F.col("x"))).alias("s"), F.count(F.lit(1)).alias("cnt")
    )
    return agg


def mgf_curves(
    proc: DataFrame,
    stats: DataFrame,
    thetas,
    *,
    kind: str,
    max_l: int,
    min_l: int = 1,
    semantics: str = "reference",
    method: str = "kernel",
    block_rows: int | None = None,
    plan: tuple[int, int] | None = None,
) -> DataFrame:
    """(username, tkey, theta, lag, mgf, logmgf) over the valid lags.

    ``proc`` (username, idx, pre) and ``stats`` (username, n, c, r0) are a
    process and its per-user constants (see ``operators.process``). A theta
    frame may carry its own scale ``c`` per theta (e.g. services rescaled per
    mu): the exponent is then theta / c * raw sum. ``plan``: a ``kernel_plan`` to reuse.
    """
    if kind not in ("arrival", "service"):
        raise ValueError(kind)
    th = theta_frame(stats, thetas).withColumn("tag", F.lit(0))
    if "c" not in th.columns:
        th = th.join(stats.select("username", "c"), "username")
    return curves_of_ranges(proc, stats, th, {0: (min_l, max_l)}, kind=kind, semantics=semantics, method=method,
                            plan=plan or (kernel_plan(stats, kind, max_l, block_rows) if method == "kernel" else None)).drop("tag")


def curves_of_ranges(proc: DataFrame, stats: DataFrame, th: DataFrame, ranges: dict[int, tuple[int, int]], *, kind: str,
                     semantics: str = "reference", method: str = "kernel", plan: tuple[int, int] | None = None) -> DataFrame:
    """(username, tag, tkey, theta, lag, mgf, logmgf) of several lag ranges in one kernel call:
    ``ranges`` gives each tag's (min_l, max_l), ``th`` (username, tag, tkey, theta, c) its thetas. A
    curve is that of ``mgf_curves`` over its own range, with the starts that range allows."""
    th = th.select("username", F.col("tag").cast("int").alias("tag"), "tkey", _signed(F.col("theta"), kind).alias("theta"), "c")
    if method == "kernel":
        most = max(max_l for _, max_l in ranges.values())
        part = _partial_sums_kernel(proc, stats, th, kind, semantics, ranges, plan or kernel_plan(stats, kind, most))
    elif method == "join":
        part = None
        for tag, (min_l, max_l) in ranges.items():
            one = _partial_sums_join(proc, stats, th.where(F.col("tag") == tag), kind, semantics, min_l, max_l)
            one = one.withColumn("tag", F.lit(tag))
            part = one if part is None else part.unionByName(one)
    else:
        raise ValueError(method)
    cur = part.join(th.drop("c"), ["username", "tag", "tkey"]).select(
        "username", "tag", "tkey", "theta", "lag", (F.col("s") / F.col("cnt")).alias("mgf")
    )
    bad = (F.col("mgf") == 0) | (F.col("mgf") == F.lit(float("inf"))) | F.isnan("mgf")
    first_bad = F.min(F.when(bad, F.col("lag"))).over(Window.partitionBy("username", "tag", "tkey"))
    cut = 1 if semantics == "reference" else 0
    end = F.lit(0)
    for tag, (_, max_l) in ranges.items():
        end = F.when(F.col("tag") == tag, max_l).otherwise(end)
    cur = cur.withColumn("_b", F.coalesce(first_bad, end))
    return cur.where(F.col("lag") < F.col("_b") - cut).select(
        "username", "tag", "tkey", "theta", "lag", "mgf", F.try_divide(F.log("mgf"), F.col("theta")).alias("logmgf")
    )
