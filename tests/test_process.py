import pytest

from sojourn.operators import process as pr


def test_arrivals_drop_one_row_vs_all_tied_rows(spark):
    jobs = spark.createDataFrame(
        [("u", 1, 10, 0), ("u", 2, 10, 0), ("u", 3, 15, 0), ("u", 4, 15, 0), ("u", 5, 30, 0), ("v", 9, 7, 0)],
        "username string, jobid long, arrive long, fail long")
    proc, st = pr.arrival_process(jobs)
    got = sorted((r.idx, r.raw, r.x, r.pre) for r in proc.where("username = 'u'").collect())
    assert got == [(0, 0, 0.0, 0), (1, 5, 1.0, 0), (2, 0, 0.0, 5), (3, 15, 3.0, 5)]
    assert {r.username: r.c for r in st.collect()} == {"u": 5.0}       # (30 - 10) div 4; v has no increment
    norm = sorted((r.arrive, r.interarrival, r.interarrivalN) for r in pr.normalized_arrivals(jobs).collect())
    assert norm == [(15, 0, 0.0), (15, 5, pytest.approx(0.75)), (30, 15, pytest.approx(2.25))]


def test_services_first_finished_task_and_task_zero(spark):
    tasks = spark.createDataFrame(
        [("u", 1, 0, 5, -1, 9), ("u", 1, 1, 6, 7, 0), ("u", 2, 0, 3, 3, 0), ("u", 3, 0, 8, 4, 0), ("u", 3, 1, 8, 100, 0)],
        "username string, jobid long, taskix long, arrive long, size long, fail long")
    proc, st = pr.service_process(tasks)
    assert sorted((r.idx, r.raw, r.pre) for r in proc.collect()) == [(0, 3, 0), (1, 7, 3), (2, 4, 10)]
    assert st.collect()[0].c == 4.0                                    # 14 div 3
    ren = {(r.mu, r.idx): r.x for r in pr.renormalized_services(proc, (2.0,)).collect()}
    assert sum(ren.values()) / 3 == pytest.approx(0.5)
    ns = sorted((r.arrive, r.size) for r in pr.normalized_services(tasks).collect())
    assert ns == [(3, 3), (8, 4)]                                      # task 0 with fail = 0 only


def test_autocorrelation_lag_one(spark):
    xs = [1, 3, 2, 5, 4, 6, 2, 1]
    series = spark.createDataFrame([("u", i, x) for i, x in enumerate(xs)], "username string, idx long, v long")
    got = {r.lag: r.acf for r in pr.autocorrelation(series, "v", 3).collect()}
    m = sum(xs) / len(xs)
    den = sum((x - m) ** 2 for x in xs)
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(sum((xs[t] - m) * (xs[t + k] - m) for t in range(len(xs) - k)) / den)


def test_autocorrelation_of_many_lags_equals_the_dot_products(spark):
    import numpy as np
    import pytest

    from sojourn.operators.process import autocorrelation

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, 12_000)
    series = spark.createDataFrame([("u", int(k), int(v)) for k, v in enumerate(x)] + [("short", k, k * k) for k in range(40)],
                                   "username string, idx long, interarrival long")
    got = {(r.username, r.lag): r.acf for r in autocorrelation(series, "interarrival", 5000, block=5500).collect()}
    y = x - x.mean()
    assert len(got) == 5000 + 39
    for k in (1, 2, 777, 4999, 5000):
        assert got[("u", k)] == pytest.approx(y[:-k] @ y[k:] / (y @ y), abs=1e-12)
    z = np.arange(40.0) ** 2
    z -= z.mean()
    assert got[("short", 39)] == pytest.approx(z[0] * z[39] / (z @ z), abs=1e-12)


def test_window_sums_of_several_widths_at_any_block(spark):
    from sojourn.operators.lagsums import window_sums

    raw = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7]
    rows = [("u", k, sum(raw[:k])) for k in range(len(raw))] + [("v", k, k) for k in range(3)]
    proc = spark.createDataFrame(rows, "username string, idx long, pre long")
    want = {(u, w, i, p[i + w] - p[i]) for u, p in (("u", [r[2] for r in rows if r[0] == "u"]), ("v", [0, 1, 2]))
            for w in (1, 2, 5) for i in range(len(p) - w)}
    for block in (5, 6, 100):
        assert {tuple(r) for r in window_sums(proc, (1, 2, 5), block).collect()} == want
