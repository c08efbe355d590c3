"""Build process frames from small explicit arrays."""

from __future__ import annotations


def process(spark, series: dict[str, list[int]], scale: dict[str, float] | None = None):
    """(proc, stats) for raw increments per user; c defaults to 1.0."""
    rows, stats = [], []
    for u, raw in series.items():
        pre = 0
        for i, r in enumerate(raw):
            c = (scale or {}).get(u, 1.0)
            rows.append((u, i, int(r), r / c if c else None, pre))
            pre += int(r)
        stats.append((u, len(raw), float((scale or {}).get(u, 1.0)), int(raw[0]), sum(raw) / len(raw)))
    proc = spark.createDataFrame(rows, "username string, idx long, raw long, x double, pre long")
    st = spark.createDataFrame(stats, "username string, n long, c double, r0 long, mean_raw double")
    return proc, st
