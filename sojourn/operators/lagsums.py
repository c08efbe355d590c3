"""Window sums of a process from exact integer prefix sums.

With pre[i] = raw[0] + ... + raw[i-1] (the process frame's ``pre``), the sum
of w consecutive increments starting at i is pre[i+w] - pre[i]: an exact
integer, divided by the user's scale c only at the end. Rows are dealt to blocks of neighbouring
positions with a halo (``halo_blocks``), which spreads a large user over all tasks: at most two
copies of a row are shuffled, however many widths or lags there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_sums(proc: DataFrame, widths: Sequence[int], block: int | None = None) -> DataFrame:
    """(username, w, idx, xsum): raw sums of ``w`` terms from ``idx``, for
    every start with a full window (idx + w <= n - 1 as a prefix index)."""
    widths = [int(w) for w in widths]
    block = max(int(block or BLOCK), max(widths))

    def run(key, rows):
        rows = rows.sort_values("idx")
        idx, pre = rows["idx"].to_numpy(), rows["pre"].to_numpy(dtype=np.int64)
        own = int(np.searchsorted(idx, (int(key[1]) + 1) * block))
        starts = [max(0, min(own, len(pre) - w)) for w in widths]
        return pd.DataFrame({"username": np.full(sum(starts), key[0], dtype=object),
                             "w": np.repeat(np.array(widths, dtype=np.int32), starts),
                             "idx": np.concatenate([idx[:k] for k in starts]),
                             "xsum": np.concatenate([pre[w:w + k] - pre[:k] for w, k in zip(widths, starts)])})

    return halo_blocks(proc.select("username", "idx", "pre"), block, max(widths)).groupBy("username", "blk").applyInPandas(
        run, "username string, w int, idx long, xsum long")


def sliding_sum(proc: DataFrame, stats: DataFrame, l: int) -> DataFrame:
    """(username, idx, lagsum): x[i] + ... + x[i+l-1] for i = 0 .. n-l-1."""
    s = window_sums(proc, [l]).join(stats.select("username", "c"), "username")
    return s.select("username", "idx", F.try_divide(F.col("xsum"), F.col("c")).alias("lagsum"))


#: Positions of a block.
BLOCK = 16_384


def halo_blocks(series: DataFrame, block: int, halo: int) -> DataFrame:
    """``series`` (username, idx, ...) with ``blk`` = idx div block; the first ``halo``
    rows of a block (halo <= block) also stand at the end of the block before it."""
    own = F.expr(f"idx div {int(block)}")
    early = (F.col("idx") >= block) & (F.col("idx") % block < halo)
    return series.select("*", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("blk"))


def lag_sums(proc: DataFrame, stats: DataFrame, max_l: int, block: int = BLOCK) -> DataFrame:
    """(username, lag, idx, lagsum): the lag-sum matrix, lag = 0 .. max_l-1,
    lagsum = x[idx] + ... + x[idx+lag] (lag + 1 terms), idx = 0 .. n-max_l-1."""
    block = max(int(block), max_l + 1)

    def run(key, rows):
        rows = rows.sort_values("idx")
        idx, pre = rows["idx"].to_numpy(), rows["pre"].to_numpy()
        n, c = int(rows["n"].iloc[0]), float(rows["c"].iloc[0])
        m = max(0, min((int(key[1]) + 1) * block, n - max_l) - int(idx[0]))  # starts of this block
        lags = np.arange(max_l)
        sums = pre[np.arange(m)[None, :] + lags[:, None] + 1] - pre[None, :m] if m else np.empty((max_l, 0))
        return pd.DataFrame({"username": np.full(max_l * m, key[0], dtype=object), "lag": np.repeat(lags, m).astype(np.int32),
                             "idx": np.tile(idx[:m], max_l), "lagsum": (sums / c).ravel()})

    rows = proc.select("username", "idx", "pre").join(stats.select("username", "n", "c"), "username")
    return halo_blocks(rows, block, max_l + 1).groupBy("username", "blk").applyInPandas(
        run, "username string, lag int, idx long, lagsum double")


def window_mgf(proc: DataFrame, stats: DataFrame, width: int, thetas: Sequence[float]) -> DataFrame:
    """(username, theta, mgf, logmgf) of the ``width``-term sums at each theta:
    mgf = mean over starts of exp(theta * sum), logmgf = ln(mgf) / theta."""
    s = window_sums(proc, [width]).join(stats.select("username", "c"), "username")
    th = F.explode(F.array(*[F.lit(float(t)) for t in thetas])).alias("theta")
    e = s.select("username", th, "xsum", "c")
    agg = e.groupBy("username", "theta").agg(F.avg(F.exp(F.try_divide(F.col("theta"), F.col("c")) * F.col("xsum"))).alias("mgf"))
    return agg.select("username", "theta", "mgf", F.try_divide(F.log("mgf"), F.col("theta")).alias("logmgf"))
