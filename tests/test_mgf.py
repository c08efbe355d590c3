import math
import random

import pytest

from brute import mgf_curve
from frames import process
from sojourn.operators import lagsums as ls
from sojourn.operators.mgf import mgf_curves


def curve_rows(df):
    return {(r.username, r.tkey, r.lag): r.logmgf for r in df.collect()}


def test_mgf_tiny_by_hand(spark):
    proc, st = process(spark, {"u": [1, 2, 3, 4, 5, 6]})
    a = curve_rows(mgf_curves(proc, st, [0.1], kind="arrival", max_l=3))
    m = (math.exp(-0.3) + math.exp(-0.5) + math.exp(-0.7)) / 3
    assert list(a) == [("u", 0, 1)]
    assert a[("u", 0, 1)] == pytest.approx(math.log(m) / -0.1, rel=1e-12)
    s = curve_rows(mgf_curves(proc, st, [0.1], kind="service", max_l=3))
    m = (math.exp(0.6) + math.exp(0.8)) / 2          # x0 + x[i+1] + x[i+2]: 1+2+3, 1+3+4
    assert s[("u", 0, 1)] == pytest.approx(math.log(m) / 0.1, rel=1e-12)
    d = curve_rows(mgf_curves(proc, st, [0.1], kind="arrival", max_l=3, semantics="documented"))
    assert sorted(k[2] for k in d) == [1, 2]
    m1 = (math.exp(-0.1) + math.exp(-0.2) + math.exp(-0.3)) / 3
    assert d[("u", 0, 1)] == pytest.approx(math.log(m1) / -0.1, rel=1e-12)


@pytest.mark.parametrize("kind", ["arrival", "service"])
@pytest.mark.parametrize("semantics", ["reference", "documented"])
def test_kernel_and_join_match_brute_force(spark, kind, semantics):
    rng = random.Random(11)
    series = {"big": [rng.randrange(1, 50) for _ in range(157)], "small": [rng.randrange(1, 9) for _ in range(23)],
              "tiny": [3, 4]}
    scale = {"big": 25.0, "small": 5.0, "tiny": 3.0}
    proc, st = process(spark, series, scale)
    thetas = [0.3, 2.0, 30.0]      # the last one under/overflows and cuts the curve
    max_l = 12
    want = {}
    for u, raw in series.items():
        x = [r / scale[u] for r in raw]
        for k, t in enumerate(thetas):
            for lag, _, lm in mgf_curve(x, t, max_l, kind, semantics):
                want[(u, k, lag)] = lm
    for method, block in (("kernel", 5), ("kernel", 1 << 15), ("join", 0)):
        got = curve_rows(mgf_curves(proc, st, thetas, kind=kind, max_l=max_l, semantics=semantics,
                                    method=method, block_rows=block or 1 << 15))
        assert set(got) == set(want), (method, block)
        for key, v in want.items():
            assert got[key] == pytest.approx(v, rel=1e-9, abs=1e-12), (method, block, key)


def test_overflow_ends_curve(spark):
    raw = [1] * 30
    raw[15] = 10_000
    proc, st = process(spark, {"u": raw})
    got = curve_rows(mgf_curves(proc, st, [0.5], kind="service", max_l=10))
    want = mgf_curve(raw, 0.5, 10, "service")
    assert sorted(k[2] for k in got) == [w[0] for w in want]
    assert len(want) < 8


def test_window_and_lag_sums(spark):
    raw = [5, 1, 4, 2, 8, 3]
    proc, st = process(spark, {"u": raw}, {"u": 2.0})
    s = {r.idx: r.lagsum for r in ls.sliding_sum(proc, st, 3).collect()}
    assert s == {0: 5.0, 1: 3.5, 2: 7.0}
    m = {(r.lag, r.idx): r.lagsum for r in ls.lag_sums(proc, st, 3).collect()}
    assert m == {(0, 0): 2.5, (0, 1): 0.5, (0, 2): 2.0, (1, 0): 3.0, (1, 1): 2.5, (1, 2): 3.0,
                 (2, 0): 5.0, (2, 1): 3.5, (2, 2): 7.0}
