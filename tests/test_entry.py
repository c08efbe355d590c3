def test_entry_returns_bounds(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["username", "mu", "theta", "tau1", "tauk"]
    rows = df.collect()
    assert len(rows) > 0
    assert all(r.tau1 > 0 and r.tauk > r.tau1 for r in rows)
