"""Sliding fits from prefix moments against a fit of every window."""

import math

import numpy as np
import pytest

from sojourn.operators.linearity import linearity_span


def test_span_of_long_curves(spark):
    max_l, rows = 2000, []
    rng = np.random.default_rng(4)
    for key, n in ((0, 1999), (1, 1200), (2, 505)):  # the last is too short for windows of 500
        f = 3.0 * np.arange(1, n + 1) + 50 * np.sin(np.arange(n) / 90) + rng.normal(size=n) + 1e4
        rows += [("u", key, 0.5, lag + 1, float(v)) for lag, v in enumerate(f)]
    curves = spark.createDataFrame(rows, "username string, tkey long, theta double, lag int, logmgf double")
    got = {r.tkey: r for r in linearity_span(None, None, "arrival", max_l, curves=curves).collect()}
    for key in range(3):
        f = np.array([r[4] for r in rows if r[1] == key])
        w = 500
        if len(f) < w + 10:
            assert (got[key].min_b, got[key].max_b, got[key].angle) == (0, 0, 0)
            continue
        x = np.arange(w) - (w - 1) / 2
        slopes = [x @ f[k:k + w] / (x @ x) for k in range(len(f) - w)]
        assert got[key].min_b == pytest.approx(min(slopes), rel=1e-9) and got[key].max_b == pytest.approx(max(slopes), rel=1e-9)
        assert got[key].angle == pytest.approx(math.atan(max(slopes)) - math.atan(min(slopes)), rel=1e-6)
