"""Brute-force references for tests: plain loops over small NumPy arrays,
written from the formulas in the operator docstrings."""

from __future__ import annotations

import math

import numpy as np


def mgf_curve(x, theta, max_l, kind, semantics="reference", min_l=1):
    """[(lag, mgf, logmgf)] of a normalized process x (1-d array)."""
    x = np.asarray(x, dtype=float)
    th = -abs(theta) if kind == "arrival" else abs(theta)
    n = len(x)
    m = n - max_l if kind == "arrival" else n - max_l - 1
    if m < 1:
        return []
    out = []
    for lag in range(min_l, max_l):
        sums = []
        for i in range(m):
            if semantics == "reference":
                s = x[i:i + lag + 1].sum() if kind == "arrival" else x[0] + x[i + 1:i + lag + 2].sum()
            else:
                s = x[i:i + lag].sum() if kind == "arrival" else x[i:i + lag + 1].sum()
            sums.append(s)
        with np.errstate(over="ignore", under="ignore"):
            mg = float(np.mean(np.exp(th * np.asarray(sums))))
        if mg == 0 or math.isinf(mg):
            cut = lag - (1 if semantics == "reference" else 0)
            return [r for r in out if r[0] < cut]
        out.append((lag, mg, math.log(mg) / th))
    cut = max_l - (1 if semantics == "reference" else 0)
    return [r for r in out if r[0] < cut]


def crossing(xa, xs, l, variant="lag"):
    """(theta, found) of the step-by-step log-scale bisection."""
    xa, xs = np.asarray(xa, float), np.asarray(xs, float)
    sx = 1 if variant == "lag" else 0
    right = 10.0 - 1e-5 if variant == "lag" else 1.0 - 1e-5
    adiv = l if variant == "lag" else 1.0
    sdiv = l + 1 if variant == "lag" else 1.0
    a = np.array([xa[i:i + l].sum() for i in range(len(xa) - l)])
    s = np.array([xs[i:i + l + sx].sum() for i in range(len(xs) - l - sx)])
    lt, rt = 1e-10, right
    theta = lt

    def means(t):
        with np.errstate(over="ignore", under="ignore"):
            return float(np.mean(np.exp(-t * a))), float(np.mean(np.exp(t * s)))

    mma, mms = means(theta)
    rhoa = math.inf if mma == 0 else math.log(mma) / (-theta * adiv)
    rhos = math.log(mms) / (theta * sdiv)
    ct, found, last = 0, False, theta
    while abs(rhoa - rhos) > 1e-4 and ct < 5000:
        mma, mms = means(theta)
        if mma == 0.0 or math.isinf(mms):
            rt = theta
        else:
            rhoa = math.log(mma) / (-theta * adiv)
            rhos = math.log(mms) / (theta * sdiv)
            if rhos > rhoa:
                rt, found = theta, True
            else:
                lt = theta
        theta = math.exp((math.log(rt) + math.log(lt)) / 2)
        ct += 1
        if abs(theta - last) < 1e-10:
            ct = 5000
        last = theta
    return theta, found


def envelopes(fa, fs, theta):
    """Reference-semantics envelope rows (s, a, sigmaa, rhoa, sigmas, rhos, alpha)."""
    n = min(len(fa), len(fs))
    if n < 10:
        return []
    lwin = n // 10
    sa = [(fa[p + lwin] - fa[p]) / lwin for p in range(n - lwin)]
    ss = [(fs[p + lwin] - fs[p]) / lwin for p in range(n - lwin)]
    min_a, max_a = min(1e99, min(sa)), max(0.0, max(sa))
    min_s, max_s = min(1e99, min(ss)), max(0.0, max(ss))
    min_a = max(min_a, min_s)
    if min_a > max_a or min_s > max_s:
        return []
    rows = []
    for i_s in range(10):
        rhos = min_s + (max_s - min_s) * (i_s / 10.0)
        sigmas = max(fs[p] - p * rhos for p in range(len(fs))) - rhos
        sigmaa = max(p * rhos - fs[p] for p in range(n))
        for i_a in range(1, 11):
            rhoa = min_a + (max_a - min_a) * (i_a / 10.0)
            den = 1 - math.exp(-theta * (rhoa - rhos))
            alpha = math.exp(theta * (sigmaa + sigmas)) / den if den != 0 else math.inf
            rows.append((i_s, i_a, sigmaa, rhoa, sigmas, min_s, alpha))
    return rows


def crossing_slope(xa, xs, l, window):
    """(theta, found) of the slope-based bisection (reference semantics)."""
    def slope(curve):
        if len(curve) < 2:
            return math.nan
        lag = np.array([c[0] for c in curve], float)
        y = np.array([c[2] for c in curve], float)
        return float(np.polyfit(lag, y, 1)[0])

    def rhos_at(t):
        ca = mgf_curve(xa, t, l + window, "arrival", min_l=l)
        cs = mgf_curve(xs, t, l + window, "service", min_l=l)
        return ca, cs

    lt, rt = 1e-10, 10.0 - 1e-5
    theta = lt
    ca, cs = rhos_at(theta)
    rhoa, rhos = slope(ca), slope(cs)
    ct, found, last = 0, False, theta
    while abs(rhoa - rhos) > 1e-4 and ct < 5000:
        ca, cs = rhos_at(theta)
        if len(ca) < 10 or len(cs) < 10:
            rt = theta
        else:
            rhoa, rhos = slope(ca), slope(cs)
            if rhos > rhoa:
                rt, found = theta, True
            else:
                lt = theta
        theta = math.exp((math.log(rt) + math.log(lt)) / 2)
        ct += 1
        if abs(theta - last) < 1e-10:
            ct = 5000
        last = theta
    return theta, found
