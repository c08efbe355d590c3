import math

import pytest

from brute import envelopes
from sojourn.operators.bounds import best_bounds, tau_quantiles
from sojourn.operators.envelope import envelope_fit


def test_envelope_fit_matches_formulas(spark):
    fa = [0.9 * (p + 1) + 0.3 * math.sin(p) for p in range(30)]
    fs = [0.7 * (p + 2) + 0.2 * math.cos(p) for p in range(33)]
    theta = 0.4
    rows = [("u", 1.5, 0, theta, "A", p, f) for p, f in enumerate(fa)] + \
           [("u", 1.5, 0, theta, "S", p, f) for p, f in enumerate(fs)]
    curves = spark.createDataFrame(rows, "username string, mu double, cand int, theta double, kind string, p int, f double")
    got = {(r.s_line, r.a_line): r for r in envelope_fit(curves).collect()}
    want = envelopes(fa, fs, theta)
    assert len(got) == len(want) == 100
    for s, a, sa, ra, ss, rs, al in want:
        r = got[(s, a)]
        assert (r.sigmaa, r.rhoa, r.sigmas, r.rhos) == pytest.approx((sa, ra, ss, rs), rel=1e-12)
        assert r.alpha == pytest.approx(al, rel=1e-9)
    taus = tau_quantiles(envelope_fit(curves)).collect()
    for r in taus:
        if r.tau1 != 0.0 and r.tau1 is not None and not math.isnan(r.tau1):
            assert r.tauk - r.tau1 == pytest.approx(math.log(16) / theta, rel=1e-9)
    best = best_bounds(tau_quantiles(envelope_fit(curves))).collect()
    pos = [r.tau1 for r in taus if r.tau1 is not None and r.tau1 > 0 and not math.isinf(r.alpha)]
    assert len(best) == (1 if pos else 0)
    if pos:
        assert best[0].tau1 == min(pos)


def test_short_curves_give_no_envelope(spark):
    rows = [("u", 1.0, 0, 0.5, k, p, float(p)) for k in "AS" for p in range(9)]
    curves = spark.createDataFrame(rows, "username string, mu double, cand int, theta double, kind string, p int, f double")
    assert envelope_fit(curves).count() == 0
