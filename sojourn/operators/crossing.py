"""Crossing theta: log-scale bisection for the theta where the arrival and
service rates of the MGF envelopes cross, for every (user, mu, lag) at once.

At lag l, with A(i) the sums of l consecutive normalized inter-arrivals and
S(i) the sums of l+1 consecutive normalized service times (``variant="lag"``):
  rhoA(theta) = ln(mean exp(-theta A)) / (-theta l)
  rhoS(theta) = ln(mean exp( theta S)) / (theta (l + 1)).
Fixed values of the search: bracket [1e-10, 10 - 1e-5], start at the left
end; stop when |rhoA - rhoS| <= 1e-4, after 5000 steps, or when theta moves
less than 1e-10. Per step, at theta: if mean exp(-theta A) is 0 or
mean exp(theta S) is infinite, right = theta (rhos kept from before);
else if rhoS > rhoA, right = theta (a crossing was seen); else left = theta;
then theta = exp((ln right + ln left) / 2). The value returned is that next
theta, also when no crossing was found (``found`` tells).

``variant="single_window"``: both sums have l terms, rho is not divided by
the lag, bracket upper end 1 - 1e-5, data from the normalized frames that
drop all rows tied with the first arrival. ``crossing_theta_slope``: the rhos are
least-squares slopes of log-MGF curves.

Plan. A small state frame (username, mu, l) goes through a few passes. The branch a
step takes depends on two means only, so the thetas of the next steps are known in
advance: a pass evaluates the complete tree of the next ``depth`` steps and the two
straight paths from the root ``CHAIN`` steps further (a search without a crossing
walks one way for about 42 steps), then every state walks as far as its nodes were
evaluated. The thetas visited are those of a step-by-step search. What a mean needs of the data
is the multiset of window sums, (user, lag, side, sum, multiplicity): it is written once, without
mu (mu only scales a theta), from halo blocks of the prefix sums, in arrays of about BLOCK distinct sums.
A pass never moves them: the open states (a few numbers each) are broadcast to the arrays,
whose task makes the thetas, evaluates exp once per distinct sum and theta and
returns one partial sum per theta; a plain aggregate adds these up. Nothing of the size windows x
thetas is ever a row. States are searched in slices of users that fit the broadcast bound;
the arrays are written in the same slices, so every slice reads its own. Users without a scale
(only zero increments) have no state. All scratch of a search goes when it ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from ..session import scratch_path, scratch_scope
from .lagsums import BLOCK as HALO_BLOCK
from .lagsums import halo_blocks

# fixed values of the search
LEFT = 1e-10
RIGHT_LAG = 10.0 - 1e-5
RIGHT_SINGLE = 1.0 - 1e-5
THRESHOLD = 1e-4
THETA_PROGRESS = 1e-10
MAX_STEPS = 5000

KEY = ["username", "mu", "l"]
#: Steps of the complete tree of one pass (2^DEPTH - 1 thetas for each state), and steps
#: that the two straight paths go on (2 * CHAIN more). Work of a pass: window sums of a
#: state times these thetas.
DEPTH, CHAIN = 6, 45
#: Distinct window sums in one array, about.
BLOCK = 4096
#: Bytes of a written partition of arrays.
FILE_BYTES = 8 << 20
#: States of one slice of a search, as a broadcast takes them: bytes in all, and of one.
BROADCAST_BYTES, STATE_BYTES = 16 << 20, 128


def _gt(a, b):
    """a > b with Scala/IEEE semantics: false when either side is NaN/NULL."""
    return F.coalesce((a > b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def mid(a, b):
    """exp((ln a + ln b) / 2): the log-scale midpoint of a bracket."""
    return np.exp((np.log(a) + np.log(b)) / 2)


def tree_thetas(lt: float, rt: float, theta: float, depth: int, chain: int) -> dict[str, float]:
    """{path: theta} of the nodes of the next steps; a path has "R" for a step that
    moves the right end to theta and "L" for one that moves the left end. All paths
    shorter than ``depth``, and the straight ones shorter than ``depth + chain``."""
    out, paths = {}, [""]
    lts, rts, ths = np.array([lt]), np.array([rt]), np.array([theta])
    for level in range(depth + chain):
        if level >= depth:  # only the two straight paths go on
            at = [k for k, p in enumerate(paths) if p in ("R" * level, "L" * level)]
            paths, lts, rts, ths = [paths[k] for k in at], lts[at], rts[at], ths[at]
        out.update(zip(paths, ths.tolist()))
        paths = [p + c for c in "RL" for p in paths]
        lts, rts, ths = (np.concatenate([lts, ths]), np.concatenate([ths, rts]),
                         np.concatenate([mid(ths, lts), mid(rts, ths)]))
    return out


STATE = ("username string, mu double, l int, c double, mean_raw double, lt double, rt double, theta double, rhoa double, "
         "rhos double, last double, found boolean, steps int, stop string")
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def why_stop(rhoa: float, rhos: float, moved: float, steps: int) -> str | None:
    """Why a search ends here: "still" (theta no longer moves), "near" (the rhos
    meet, or one is NaN), "steps"; None if it goes on."""
    if moved < THETA_PROGRESS:
        return "still"
    if not abs(rhoa - rhos) > THRESHOLD:
        return "near"
    return "steps" if steps >= MAX_STEPS else None


def walk(state: dict, thetas: dict[str, float], rates: dict[str, tuple[bool, float, float]]) -> dict:
    """The steps of one search as far as its nodes are known. ``rates``: path ->
    (bad, rhoA, rhoS); a path in ``thetas`` but not here had no window at all."""
    s, path, nan = dict(state), "", float("nan")
    if s["stop"] == "start":  # the rates at the start count as a step's, without a step
        _, s["rhoa"], s["rhos"] = rates.get("", (False, nan, nan))
        s["stop"] = why_stop(s["rhoa"], s["rhos"], float("inf"), 0)
    while s["stop"] is None and path in thetas:
        bad, rhoa, rhos = rates.get(path, (False, nan, nan))
        if not bad:
            s["rhoa"], s["rhos"] = rhoa, rhos
        if bad or rhos > rhoa:
            s["rt"], path = s["theta"], path + "R"
            s["found"] = s["found"] or not bad
        else:
            s["lt"], path = s["theta"], path + "L"
        s["theta"] = float(mid(s["rt"], s["lt"])) if path not in thetas else thetas[path]
        s["steps"] += 1
        s["stop"] = why_stop(s["rhoa"], s["rhos"], abs(s["theta"] - s["last"]), s["steps"])
        s["last"] = s["theta"]
    return s


def initial_states(arr_stats: DataFrame, svc_stats: DataFrame, lags, mus, right: float) -> DataFrame:
    """One state at the left end of the bracket for each (username, mu, l), with
    the scales of both processes."""
    users = arr_stats.select("username", "c").join(svc_stats.select("username", "mean_raw"), "username")
    users = users.where((F.col("c") > 0) & (F.col("mean_raw") > 0))
    grid = users.select("*", F.explode(F.array(*[F.lit(float(m)) for m in mus])).alias("mu"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("l"))
    nan = F.lit(float("nan"))
    return grid.select(
        "username", "mu", "l", "c", "mean_raw", F.lit(LEFT).alias("lt"), F.lit(right).alias("rt"), F.lit(LEFT).alias("theta"),
        nan.alias("rhoa"), nan.alias("rhos"), F.lit(LEFT).alias("last"), F.lit(False).alias("found"), F.lit(0).alias("steps"),
        F.lit("start").alias("stop"))


def open_states(states: DataFrame) -> DataFrame:
    return states.where(F.col("stop").isNull() | (F.col("stop") == "start"))


def bisect(states: DataFrame, step) -> DataFrame:
    """Run passes until no state is open. ``step(open, how many)`` returns these
    states after one pass."""
    states = materialize(states)
    while n := open_states(states).count():
        done = states.where(F.col("stop").isNotNull() & (F.col("stop") != "start"))
        states = materialize(done.unionByName(step(open_states(states), n)))
    return states


def sum_multiset(arr_proc: DataFrame, arr_stats: DataFrame, svc_proc: DataFrame, svc_stats: DataFrame, lags: Sequence[int],
                 s_extra: int, slices: int = 1, block: int = HALO_BLOCK) -> DataFrame:
    """(username, l, side, xs, ms, slice): the distinct window sums of each user, lag and side (0
    arrivals, 1 services) with their multiplicities, in arrays of about BLOCK. Every prefix row is
    shuffled to at most two halo blocks, whatever the number of lags; a block sends its distinct sums on."""
    extra = (0, s_extra)
    halo = max(lags) + s_extra
    block = max(int(block), halo)

    def rows(proc, stats, side):
        return proc.select("username", "idx", "pre").join(stats.select("username", "n"), "username").select(
            "username", F.lit(side).alias("side"), "idx", "pre", "n")

    def sums(key, pdf):
        pdf = pdf.sort_values("idx")
        idx, pre = pdf["idx"].to_numpy(), pdf["pre"].to_numpy(dtype=np.int64)
        own = int(np.searchsorted(idx, (int(key[2]) + 1) * block))
        chunks = -(-int(pdf["n"].iloc[0]) // BLOCK)
        out = []
        for l in lags:
            w = l + extra[int(key[1])]
            k = min(own, len(pre) - w)
            if k > 0:
                x, m = np.unique(pre[w:w + k] - pre[:k], return_counts=True)
                part = ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(chunks)
                out.append(pd.DataFrame({"username": key[0], "l": l, "side": int(key[1]), "part": part.astype(np.int64), "x": x, "m": m}))
        return pd.concat(out) if out else pd.DataFrame(columns=["username", "l", "side", "part", "x", "m"])

    both = rows(arr_proc, arr_stats, 0).unionByName(rows(svc_proc, svc_stats, 1))
    found = halo_blocks(both, block, halo).groupBy("username", "side", "blk").applyInPandas(
        sums, "username string, l int, side int, part long, x long, m long")
    spark = both.sparkSession
    windows = sum(int(st.agg(F.sum("n")).first()[0] or 0) for st in (arr_stats, svc_stats)) * len(lags)
    files = max(-(-16 * windows // FILE_BYTES), min(-(-windows // BLOCK), spark.sparkContext.defaultParallelism))
    key = ["username", "l", "side", "part"]
    merged = found.repartition(max(1, files), *key).groupBy(*key, "x").agg(F.sum("m").alias("m"))  # one exchange for both aggregates
    arrays = merged.groupBy(*key).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "m")).alias("z")).select(
        "username", "l", "side", F.col("z.x").alias("xs"), F.col("z.m").alias("ms"), _slice(slices))
    path = scratch_path(spark, "sums")
    arrays.write.mode("overwrite").partitionBy("slice").parquet(path)
    return spark.read.schema(arrays.schema).parquet(path)


def _slice(slices: int):
    return F.pmod(F.xxhash64("username"), F.lit(slices)).cast("int").alias("slice")


def coefficients(states: list[dict], depth: int, chain: int) -> tuple[list[float], list[float]]:
    """The distinct exponents per unit of raw sum of the next steps' thetas: arrivals, services."""
    arr, svc = set(), set()
    for s in states:
        for theta in tree_thetas(s["lt"], s["rt"], s["theta"], depth, chain).values():
            arr.add(-theta / s["c"])
            svc.add(theta / (s["mu"] * s["mean_raw"]))
    return sorted(arr), sorted(svc)


def _partial(depth: int, chain: int):
    """Partial sums of m exp(coef * x) over each array, one per coefficient."""

    def run(batches):
        known: dict[tuple, tuple] = {}
        for pdf in batches:
            coefs, sums = [], []
            for user, l, side, xs, ms, states in zip(pdf["username"], pdf["l"], pdf["side"], pdf["xs"], pdf["ms"], pdf["states"]):
                if (user, l) not in known:
                    known = {(user, l): coefficients([r if isinstance(r, dict) else r.asDict() for r in states], depth, chain)}
                x, m, c = np.asarray(xs), np.asarray(ms, dtype=np.float64), np.asarray(known[user, l][side])
                with np.errstate(over="ignore", under="ignore"):
                    sums.append(np.concatenate([np.exp(np.outer(c[k:k + 64], x)) @ m for k in range(0, len(c), 64)]))
                coefs.append(c)
            yield pd.DataFrame({"username": pdf["username"], "l": pdf["l"], "side": pdf["side"], "coef": coefs,
                                "sums": sums, "n": [int(np.sum(m)) for m in pdf["ms"]]})

    return run


def _walker(depth: int, chain: int, variant: str):
    def run(key, states, means):
        table = {(side, coef): total / n for side, coef, total, n in
                 zip(means["side"], means["coef"], means["total"], means["n"])}
        out = []
        for s in states.to_dict("records"):
            a_div, s_div = (float(s["l"]), float(s["l"] + 1)) if variant == "lag" else (1.0, 1.0)
            thetas = tree_thetas(s["lt"], s["rt"], s["theta"], depth, chain)
            rates = {}
            for path, theta in thetas.items():
                a, b = table.get((0, -theta / s["c"])), table.get((1, theta / (s["mu"] * s["mean_raw"])))
                nan = float("nan")
                rhoa = nan if a is None else math.inf if a == 0 else math.log(a) / (-theta * a_div)
                rhos = nan if b is None else math.log(b) / (theta * s_div)
                rates[path] = (a == 0 or b == math.inf, rhoa, rhos)
            out.append(walk(s, thetas, rates))
        return pd.DataFrame(out, columns=STATE_COLUMNS)

    return run


def _result(states: DataFrame) -> DataFrame:
    near = ~_gt(F.abs(F.col("rhoa") - F.col("rhos")), F.lit(THRESHOLD))
    return states.select(*KEY, "theta", "found", near.alias("converged"), "steps")


def crossing_theta(
    arr_proc: DataFrame, arr_stats: DataFrame, svc_proc: DataFrame, svc_stats: DataFrame,
    lags: Sequence[int], mus: Sequence[float], *, variant: str = "lag", depth: int = DEPTH, chain: int = CHAIN,
) -> DataFrame:
    """(username, mu, l, theta, found, converged, steps).

    ``arr_stats`` needs (username, c); ``svc_stats`` (username, mean_raw): the
    services are rescaled per mu to c = mu * mean_raw. Users with c <= 0 or
    mean_raw <= 0 are left out.
    """
    if variant not in ("lag", "single_window"):
        raise ValueError(variant)
    lags = [int(x) for x in lags]
    right = RIGHT_LAG if variant == "lag" else RIGHT_SINGLE
    with scratch_scope(arr_proc.sparkSession) as keep:
        states = materialize(initial_states(arr_stats, svc_stats, lags, mus, right))
        slices = max(1, -(-states.count() * STATE_BYTES // BROADCAST_BYTES))
        arrays = sum_multiset(arr_proc, arr_stats, svc_proc, svc_stats, lags, 1 if variant == "lag" else 0, slices)
        done = None
        for k in range(slices):
            one = bisect(states.where(_slice(slices) == k), _passes(arrays.where(F.col("slice") == k), depth, chain, variant))
            done = one if done is None else done.unionByName(one)
        return keep(_result(done))


def _passes(arrays: DataFrame, depth: int, chain: int, variant: str):
    def step(states: DataFrame, n: int) -> DataFrame:
        needed = ("mu", "lt", "rt", "theta", "c", "mean_raw")
        asked = states.groupBy("username", "l").agg(F.collect_list(F.struct(*needed)).alias("states"))  # one a mu
        joined = arrays.join(F.broadcast(asked), ["username", "l"])  # n states of at most one slice
        parts = joined.select("username", "l", "side", "xs", "ms", "states").mapInPandas(
            _partial(depth, chain), "username string, l int, side int, coef array<double>, sums array<double>, n long")
        flat = parts.select("username", "l", "side", "n", F.explode(F.arrays_zip("coef", "sums")).alias("z"))
        means = flat.groupBy("username", "l", "side", F.col("z.coef").alias("coef")).agg(
            F.sum("z.sums").alias("total"), F.sum("n").alias("n"))
        return states.groupBy("username", "l").cogroup(means.groupBy("username", "l")).applyInPandas(
            _walker(depth, chain, variant), STATE)

    return step


SLOPE_MIN_LAGS = 10


def crossing_theta_slope(
    arr_proc: DataFrame, arr_stats: DataFrame, svc_proc: DataFrame, svc_stats: DataFrame,
    lags: Sequence[int], mus: Sequence[float], window: int, *, depth: int = DEPTH - 1, chain: int = CHAIN,
    semantics: str = "reference", method: str = "kernel",
) -> DataFrame:
    """(username, mu, l, theta, found, converged, steps): the bisection of
    ``crossing_theta`` where rhoA and rhoS are the least-squares slopes of the
    arrival and service log-MGF curves over lags l .. l + window (curves cut at
    their first infinite value); fewer than 10 valid lags on either side moves
    the right end. Same bracket and stopping rules as ``variant="lag"``. A pass calls
    the MGF kernel once per process, for all lags and open states together."""
    from .mgf import curves_of_ranges, kernel_plan

    lags, window = [int(x) for x in lags], int(window)
    ranges = {l: (l, l + window) for l in lags}
    plans = {kind: kernel_plan(stats, kind, max(lags) + window)
             for kind, stats in (("arrival", arr_stats), ("service", svc_stats))} if method == "kernel" else {}

    def nodes_of(pdfs):
        for pdf in pdfs:
            rows = []
            for s in pdf.to_dict("records"):
                thetas = sorted(set(tree_thetas(s["lt"], s["rt"], s["theta"], depth, chain).values()))
                rows += [(s["username"], s["l"], round(s["mu"] * 1_000_000) * 1000 + k, t, s["c"], s["mu"] * s["mean_raw"])
                         for k, t in enumerate(thetas)]
            yield pd.DataFrame(rows, columns=["username", "l", "tkey", "theta", "ca", "cs"])

    def slopes(nodes: DataFrame, kind: str) -> DataFrame:
        proc, stats, scale = (arr_proc, arr_stats, "ca") if kind == "arrival" else (svc_proc, svc_stats, "cs")
        th = nodes.select("username", F.col("l").alias("tag"), "tkey", "theta", F.col(scale).alias("c"))
        curve = curves_of_ranges(proc, stats, th, ranges, kind=kind, semantics=semantics, method=method, plan=plans.get(kind))
        return curve.groupBy("username", "tag", "tkey").agg(
            F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("logmgf"), F.col("lag").cast("double")).alias("slope")
        ).select("username", F.col("tag").alias("l"), F.lit(kind).alias("kind"), "tkey", "n", "slope")

    def walker(key, states, found):
        table = {(kind, k): (n, slope) for kind, k, n, slope in zip(found["kind"], found["tkey"], found["n"], found["slope"])}
        out, nan = [], float("nan")
        for s in states.to_dict("records"):
            thetas = tree_thetas(s["lt"], s["rt"], s["theta"], depth, chain)
            place = {t: round(s["mu"] * 1_000_000) * 1000 + k for k, t in enumerate(sorted(set(thetas.values())))}
            rates = {}
            for path, theta in thetas.items():
                (na, a), (ns, b) = (table.get((kind, place[theta]), (0, nan)) for kind in ("arrival", "service"))
                rates[path] = (na < SLOPE_MIN_LAGS or ns < SLOPE_MIN_LAGS, a, b)
            out.append(walk(s, thetas, rates))
        return pd.DataFrame(out, columns=STATE_COLUMNS)

    def step(states: DataFrame, n: int) -> DataFrame:
        nodes = materialize(states.mapInPandas(
            nodes_of, "username string, l int, tkey long, theta double, ca double, cs double"))
        found = slopes(nodes, "arrival").unionByName(slopes(nodes, "service"))
        return states.groupBy("username", "l").cogroup(found.groupBy("username", "l")).applyInPandas(walker, STATE)

    with scratch_scope(arr_proc.sparkSession) as keep:
        return keep(_result(bisect(initial_states(arr_stats, svc_stats, lags, mus, RIGHT_LAG), step)))
