from sojourn.operators.users import ranked_heavy_users


def test_heavy_users_are_ranked_in_blocks(spark):
    """Places run on from block to block, ties across them included."""
    count = {f"u{k:02d}": 2 + k * 7 % 5 for k in range(40)} | {"light": 1}
    jobs = spark.createDataFrame([(u, j) for u, n in count.items() for j in range(n)], "username string, jobid long")
    order = sorted((-n, u) for u, n in count.items() if n > 1)
    want = [(k, u, -n) for k, (n, u) in enumerate(order, 1)]
    for block_rows in (3, 1 << 16):
        assert sorted(map(tuple, ranked_heavy_users(jobs, 1, block_rows=block_rows).collect())) == want
    assert ranked_heavy_users(jobs, 100).collect() == []
