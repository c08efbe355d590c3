import random

from sojourn.functions.ordering import ordered_index


def test_ordered_index_matches_plain_sort_across_blocks(spark):
    rng = random.Random(7)
    rows = []
    for g, size in (("hot", 400), ("a", 60), ("b", 3), ("c", 1)):
        for j in range(size):
            rows.append((g, rng.randrange(0, 5000), j, rng.randrange(0, 100)))
    df = spark.createDataFrame(rows, "g string, t long, j long, v long")
    for block in (7, 64, 1 << 16):
        out = ordered_index(df, ["g"], ["t", "j"], sum_col="v", prefix_col="pre", prev_of="t",
                            prev_col="prev", first_of="t", first_col="first", block_rows=block).collect()
        got = {(r.g, r.j): (r.idx, r.pre, r.prev, r.first) for r in out}
        for g in ("hot", "a", "b", "c"):
            mine = sorted((t, j, v) for gg, t, j, v in rows if gg == g)
            pre, prev = 0, None
            for k, (t, j, v) in enumerate(mine):
                assert got[(g, j)] == (k, pre, prev, mine[0][0]), (block, g, k)
                pre += v
                prev = t


def test_blocks_hold_a_bounded_number_of_rows(spark):
    """Neither one far outlier nor a burst within one time slice widens a block."""
    from pyspark.sql import functions as F

    from sojourn.functions.ordering import compute_partitions, range_blocks

    n, target = 40_000, 2048
    rows = spark.range(n).select(F.lit("u").alias("g"), (F.col("id") * 10).alias("t"), F.col("id").alias("j"))
    outlier = rows.unionAll(spark.sql("select 'u' as g, 9223372036854775807 as t, -1L as j"))
    burst = rows.unionAll(spark.range(n).select(F.lit("u").alias("g"), F.lit(5000).cast("long").alias("t"), (F.col("id") + n).alias("j")))
    for df, total in ((outlier, n + 1), (burst, 2 * n)):
        sizes = [r["count"] for r in range_blocks(df, ["g"], ["t", "j"], target).groupBy("_blk").count().collect()]
        assert sum(sizes) == total and max(sizes) <= 2 * target and len(sizes) >= total // target
    got = ordered_index(outlier, ["g"], ["t", "j"], prev_of="t", block_rows=target).orderBy(F.desc("idx")).first()
    assert (got.idx, got.t, got.prev) == (n, 2 ** 63 - 1, (n - 1) * 10)

    assert compute_partitions(spark, 10 ** 6) == 250_000 and compute_partitions(spark, 3) == 3


def test_no_local_folder_without_a_local_master():
    import pytest

    from sojourn.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_partitions_follow_bytes_and_the_input_is_evaluated_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sojourn.functions import ordering

    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 30_000
    rows = spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).alias("t"), F.col("id").alias("j"))
    rows = rows.mapInArrow(counting, rows.schema)
    monkeypatch.setattr(ordering, "PARTITION_BYTES", 100_000)
    width = ordering.row_bytes(rows.schema)
    assert width == 8 + 28 + 8 + 8
    dealt, parts = ordering.sorted_ranges(rows, ["g"], ["t", "j"])
    assert parts == dealt.rdd.getNumPartitions() == -(-n * width // 100_000) and seen.value == n
    out = ordered_index(rows, ["g"], ["t", "j"], prev_of="t", first_of="j", sum_col="t")
    assert out.count() == n and seen.value == 2 * n  # once more, for this call
    got = {(r.g, r.j): (r.idx, r.pre, r.prev, r.first) for r in out.collect()}
    for u in range(3):
        mine = sorted((k * 7 % 1000, k) for k in range(u, n, 3))
        total, prev = 0, None
        for i, (t, j) in enumerate(mine):
            assert got[(f"u{u}", j)] == (i, total, prev, mine[0][1])
            total, prev = total + t, t


def test_a_scope_leaves_only_what_it_keeps(spark):
    import os

    from sojourn.functions.ordering import materialize
    from sojourn.session import ensure_checkpoint_dir, scratch_scope

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch_scope(spark) as keep:
        inner = materialize(spark.range(10))
        with scratch_scope(spark) as keep_inner:
            kept = keep_inner(materialize(inner.where("id > 3")))
        assert kept.count() == 6
        out = keep(kept)
    assert out.count() == 6 and len(set(os.listdir(folder)) - before) == 1
