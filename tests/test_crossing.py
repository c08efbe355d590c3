import random

import pytest

from brute import crossing
from frames import process
from sojourn.operators.crossing import crossing_theta


@pytest.mark.parametrize("variant", ["lag", "single_window"])
def test_batch_bisection_equals_step_by_step(spark, variant):
    rng = random.Random(5)
    arr = {"u0": [rng.randrange(50, 150) for _ in range(120)], "u1": [rng.randrange(1, 300) for _ in range(90)]}
    svc = {"u0": [rng.randrange(10, 100) for _ in range(110)], "u1": [rng.randrange(1, 60) for _ in range(95)]}
    ca = {u: sum(v) // len(v) * 1.0 for u, v in arr.items()}
    ap, ast = process(spark, arr, ca)
    sp, sst = process(spark, svc)
    mus, lags = (1.2, 3.0), (1, 5, 10)
    out = {(r.username, r.mu, r.l): r for r in
           crossing_theta(ap, ast, sp, sst, lags, mus, variant=variant, depth=3).collect()}
    assert len(out) == 12
    for u in arr:
        xa = [r / ca[u] for r in arr[u]]
        mean_s = sum(svc[u]) / len(svc[u])
        for mu in mus:
            xs = [r / (mu * mean_s) for r in svc[u]]
            for l in lags:
                theta, found = crossing(xa, xs, l, variant)
                r = out[(u, mu, l)]
                assert r.theta == pytest.approx(theta, rel=1e-9), (u, mu, l)
                assert r.found == found


def test_slope_bisection_equals_step_by_step(spark):
    from brute import crossing_slope
    from sojourn.operators.crossing import crossing_theta_slope

    rng = random.Random(9)
    arr = {"u0": [rng.randrange(50, 150) for _ in range(70)]}
    svc = {"u0": [rng.randrange(10, 100) for _ in range(75)]}
    ca = {u: sum(v) // len(v) * 1.0 for u, v in arr.items()}
    ap, ast = process(spark, arr, ca)
    sp, sst = process(spark, svc)
    out = {(r.mu, r.l): r for r in crossing_theta_slope(ap, ast, sp, sst, (1, 4), (1.5,), 14, depth=4).collect()}
    xa = [r / ca["u0"] for r in arr["u0"]]
    mean_s = sum(svc["u0"]) / len(svc["u0"])
    xs = [r / (1.5 * mean_s) for r in svc["u0"]]
    for l in (1, 4):
        theta, found = crossing_slope(xa, xs, l, 14)
        assert out[(1.5, l)].theta == pytest.approx(theta, rel=1e-7), l
        assert out[(1.5, l)].found == found


def test_tree_thetas_follow_their_paths():
    """Every node's theta equals the bracket walk along its path, also deep on the
    straight paths."""
    import math

    from sojourn.operators.crossing import tree_thetas

    got = tree_thetas(1e-10, 10 - 1e-5, 1e-10, 3, 55)
    straight = [c * n for c in "LR" for n in range(3, 58)]
    assert set(got) == {"", "L", "R", "LL", "LR", "RL", "RR", *straight}
    for path, theta in got.items():
        lt, rt, th = 1e-10, 10 - 1e-5, 1e-10
        for c in path:
            if c == "R":
                rt = th
            else:
                lt = th
            th = math.exp((math.log(rt) + math.log(lt)) / 2)
        assert theta == pytest.approx(th, rel=1e-12), path


def test_user_with_only_zero_sizes_does_not_stop_the_others(spark):
    rng = random.Random(3)
    raw = {"u0": [rng.randrange(50, 150) for _ in range(60)], "zero": [rng.randrange(50, 150) for _ in range(60)]}
    sizes = {"u0": [rng.randrange(10, 100) for _ in range(60)], "zero": [0] * 60}
    ap, ast = process(spark, raw, {u: sum(v) // len(v) * 1.0 for u, v in raw.items()})
    sp, sst = process(spark, sizes, {u: sum(v) / len(v) for u, v in sizes.items()})
    assert {r.username for r in crossing_theta(ap, ast, sp, sst, (1, 5), (1.5,)).collect()} == {"u0"}


def test_bound_report_with_a_poison_user(spark):
    """A heavy user whose tasks all have size 0 yields no row; the others' rows are as without it."""
    from sojourn.operators.bounds import bound_report

    rng = random.Random(8)
    jobs, tasks = [], []
    for u, zero in (("u0", False), ("zero", True)):
        t = 1000
        for j in range(60):
            t += rng.randrange(50, 150)
            job = f"{u}-{j}".__hash__() % 10 ** 9
            size = 0 if zero else rng.randrange(5, 60)
            jobs.append((job, t, t + 1, t + 1 + size, 0, u))
            tasks.append((job, 0, t, t + 1, t + 1 + size, 0, size, u))
    jf = spark.createDataFrame(jobs, "jobid long, arrive long, schedule long, finish long, fail long, username string")
    tf = spark.createDataFrame(tasks, "jobid long, taskix long, arrive long, schedule long, finish long, fail long, size long, username string")
    both = sorted(bound_report(jf, tf, heavy_threshold=10, mus=(1.5,), max_l=16).collect())
    one = sorted(bound_report(jf.where("username = 'u0'"), tf.where("username = 'u0'"), heavy_threshold=10, mus=(1.5,), max_l=16).collect())
    assert [(r.username, r.mu) for r in both] == [(r.username, r.mu) for r in one]
    assert all(x == pytest.approx(y, rel=1e-9) for a, b in zip(both, one) for x, y in zip(a[1:], b[1:]))
    assert "zero" not in {r.username for r in both}


def test_multiset_of_window_sums(spark):
    """Each array's sums with their multiplicities are all window sums, at any block size."""
    from collections import Counter

    from sojourn.operators.crossing import sum_multiset

    rng = random.Random(2)
    arr = {"u0": [rng.randrange(1, 4) for _ in range(500)], "u1": [rng.randrange(1, 4) for _ in range(30)]}
    svc = {"u0": [rng.randrange(1, 3) for _ in range(400)], "u1": [7] * 6}
    ap, ast = process(spark, arr, {u: 1.0 for u in arr})
    sp, sst = process(spark, svc)
    for block in (25, 64, 1 << 14):
        got = {}
        for r in sum_multiset(ap, ast, sp, sst, (1, 5, 24), 1, slices=2, block=block).collect():
            c = got.setdefault((r.username, r.l, r.side), Counter())
            assert not set(c) & set(r.xs) and len(set(r.xs)) == len(r.xs)
            c.update(dict(zip(r.xs, r.ms)))
        want = {}
        for side, raws, extra in ((0, arr, 0), (1, svc, 1)):
            for u, raw in raws.items():
                for l in (1, 5, 24):
                    w = l + extra
                    # as prefix sums are given for positions 0..n-1, the last start is n - 1 - w
                    sums = Counter(float(sum(raw[i:i + w])) for i in range(len(raw) - w))
                    if sums:
                        want[(u, l, side)] = sums
        assert got == want


def test_a_pass_does_not_move_the_sums_and_a_search_leaves_only_its_result(spark, monkeypatch):
    import os

    from sojourn.operators import crossing as cr
    from sojourn.session import ensure_checkpoint_dir

    rng = random.Random(6)
    arr = {f"u{k}": [rng.randrange(50, 150) for _ in range(60)] for k in range(3)}
    svc = {u: [rng.randrange(10, 100) for _ in range(60)] for u in arr}
    ap, ast = process(spark, arr, {u: sum(v) // len(v) * 1.0 for u, v in arr.items()})
    sp, sst = process(spark, svc)
    arrays = cr.sum_multiset(ap, ast, sp, sst, (1, 5), 1)
    states = cr.initial_states(ast, sst, (1, 5), (1.5,), cr.RIGHT_LAG)
    plan = cr._passes(arrays, 3, 5, "lag")(states, 6)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: next(k for k, c in enumerate(line) if c.isalpha())
    at = next(k for k, line in enumerate(plan) if "Scan parquet" in line and "xs#" in line)
    above, now = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if line.strip() and depth(line) < now:
            above.append(line)
            now = depth(line)
    joined = next(k for k, line in enumerate(above) if "MapInPandas" in line)
    assert any("BroadcastHashJoin" in line for line in above[:joined])
    assert not any("Exchange" in line for line in above[:joined])

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    one = sorted(map(tuple, cr.crossing_theta(ap, ast, sp, sst, (1, 5), (1.5, 3.0)).collect()))
    before = set(os.listdir(folder))
    monkeypatch.setattr(cr, "BROADCAST_BYTES", 4 * cr.STATE_BYTES)  # three slices
    out = cr.crossing_theta(ap, ast, sp, sst, (1, 5), (1.5, 3.0))
    assert len(set(os.listdir(folder)) - before) == 1
    assert sorted(map(tuple, out.collect())) == one
