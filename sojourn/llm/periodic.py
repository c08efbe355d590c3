"""Operator 11, periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least 2 q words that no
neighbouring word extends. Words become numbers, the texts of a batch one array with a
number of its own between two texts, so that nothing repeats across them.

Periods below FIRST_SCALE are too short for a window: the array is compared with
itself at every such lag. Periods of the scale P <= q < 2 P are found from minimizers: every
stretch of k = P / 4 words is hashed, and a stretch is selected if its hash is the
least of some window of P / 2 neighbouring stretches. Within a run the window one period on
holds the same words, so the selected stretch comes again at distance q: pairs
of equal selected stretches at distances from P to 2 P - 1 are seeds. A seed is
extended both ways by binary search over prefix hashes; what is found is compared word by
word, and on a difference the whole lag is scanned.

No run is lost. Stretches that lie in a run of period at most k / 2 (known from the smaller
scales) are left out of the windows, so equal ones are more than k / 2 apart and a stretch has
at most 2 P / (k / 2) = 16 partners at any size of text. If a run of period q has no
other stretch in its first q words, these words are one run of a period p <= k / 2 and the
next q words another, and the two touch: each touching pair of runs of one such
period seeds every lag of the scale at the place where the first of them ends.

Edge cases. Null text, empty text or only white space: no words, no runs, empty collapsed
text. Null id: kept. Repeated rows: each gets its row. Texts of any length are read
whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches
from .text_arrays import INVERSE, BASE, powers

#: Periods below this are scanned lag by lag; scales double from here.
FIRST_SCALE = 16
#: Words of a run to be reported, at least.
MIN_LENGTH = 12


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer, so that neighbouring word numbers have unlike hashes."""
    x = (x + np.uint64(BASE)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _prefix(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of the words."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_mix(x.astype(np.uint64)) * powers(BASE, len(x)), dtype=np.uint64, out=out[1:])
    return out


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` neighbours (a power of two)."""
    step = 1
    while step < size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of True."""
    at = np.flatnonzero(equal)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1


def _at_lag(x: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of every stretch of period q with at least 2 q words."""
    start, end = _stretches(x[:-q] == x[q:])
    long = end - start >= q
    return np.column_stack((start[long], end[long] + q, np.full(long.sum(), q)))


def _common(prefix, inverse, a, b, most, back: bool) -> np.ndarray:
    """How many words agree from a and b on (``back``: before a and b), at most ``most``."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    while len(open_ := np.flatnonzero(low < high)):
        lo, hi, i, j = low[open_], high[open_], a[open_], b[open_]
        n = (lo + hi + 1) // 2
        s, t = (i - n, j - n) if back else (i, j)
        same = (prefix[s + n] - prefix[s]) * inverse[s] == (prefix[t + n] - prefix[t]) * inverse[t]
        low[open_], high[open_] = np.where(same, n, lo), np.where(same, hi, n - 1)
    return low


def _extended(x, prefix, inverse, i, j) -> np.ndarray:
    """Runs (start, end, period) around the seeds (i, j), the period being j - i."""
    q = j - i
    right = _common(prefix, inverse, i, j, len(x) - j, False)
    left = _common(prefix, inverse, i, j, i.copy(), True)
    long = left + right >= q
    found = np.unique(np.column_stack((i - left, j + right, q))[long], axis=0)
    wrong = {int(p) for s, e, p in found.tolist() if not np.array_equal(x[s:e - p], x[s + p:e])}
    if wrong:  # two stretches of one hash: take these lags word by word
        found = np.concatenate([found[~np.isin(found[:, 2], list(wrong))], *(_at_lag(x, p) for p in wrong)])
    return found


def _scale(x, prefix, inverse, runs, scale: int) -> np.ndarray:
    """Runs with a period of this scale; ``runs`` holds those of smaller periods."""
    k, window = scale // 4, scale // 2
    n = len(x) - k + 1
    seeds = []
    low = runs[runs[:, 2] <= k // 2]
    if n >= window:
        with np.errstate(over="ignore"):
            h = (prefix[k:] - prefix[:-k]) * inverse[:n]
        out = low[low[:, 1] - low[:, 0] >= k]
        mark = np.zeros(n + 1, dtype=np.int32)
        np.add.at(mark, out[:, 0], 1)
        np.add.at(mark, out[:, 1] - k + 1, -1)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        h[np.cumsum(mark[:n]) > 0] = none
        least = _sliding(h, window, np.minimum)
        held = np.zeros(n + window - 1, dtype=np.uint64)  # windows that hold a place: itself and those before
        held[window - 1:window - 1 + len(least)] = least
        at = np.flatnonzero((_sliding(held, window, np.maximum) == h) & (h != none))
        order = np.lexsort((at, h[at]))
        at, hs = at[order], h[at[order]]
        step, alive = 1, np.arange(len(at))
        while len(alive := alive[alive + step < len(at)]):
            i, j = at[alive], at[alive + step]
            near = (hs[alive] == hs[alive + step]) & (j - i < 2 * scale)
            take = near & (j - i >= scale)
            seeds.append((i[take], j[take]))
            alive = alive[near]
            step += 1
    long = low[low[:, 1] - low[:, 0] >= scale]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    touch = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1]))
    for one, two in zip(long[touch].tolist(), long[touch + 1].tolist()):
        q = np.arange(scale, min(2 * scale - 1, one[1] - one[0], two[1] - two[0]) + 1)
        if one[1] < len(x):
            q = q[x[one[1] - q] == x[one[1]]]
            seeds.append((one[1] - q, np.full(len(q), one[1])))
    if not seeds:
        return runs[:0]
    i, j = (np.concatenate(c).astype(np.int64) for c in zip(*seeds))
    with np.errstate(over="ignore"):
        return _extended(x, prefix, inverse, i, j)


def runs_of(lengths: np.ndarray, x: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, smallest period) of the runs of all texts, by start. ``x``: the words of
    the texts as numbers from 0, texts one after another with ``lengths`` words each; starts
    and ends count in ``x``."""
    order = np.argsort(-lengths, kind="stable")  # the longest first: higher scales need only them
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    size = lengths[order] + 1
    place = np.cumsum(size) - size  # where each text stands in the array with separators
    own = np.repeat(begin[order] - place, size)
    at = np.arange(int(size.sum()))
    source = at + own
    ends = place + size - 1
    y = x[np.minimum(source, max(len(x) - 1, 0))].astype(np.int64) if len(x) else np.zeros(len(at), dtype=np.int64)
    y[ends] = (int(x.max()) + 1 if len(x) else 0) + np.arange(len(ends))
    runs = np.empty((0, 3), dtype=np.int64)
    if len(x) and len(y) > FIRST_SCALE:
        with np.errstate(over="ignore"):
            prefix = _prefix(y)
        inverse = powers(INVERSE, len(y) + 1)
        runs = np.concatenate([_at_lag(y, q) for q in range(1, FIRST_SCALE)])
        runs = _smallest(runs)
        scale = FIRST_SCALE
        while scale * 2 <= lengths.max():
            cut = int(ends[np.count_nonzero(lengths[order] >= 2 * scale) - 1]) + 1
            runs = _smallest(np.concatenate((runs, _scale(
                y[:cut], prefix[:cut + 1], inverse[:cut + 1], runs[runs[:, 1] <= cut], scale))))
            scale *= 2
    elif len(x):
        runs = _smallest(np.concatenate([_at_lag(y, q) for q in range(1, max(2, len(y) // 2 + 1))]))
    runs = runs[runs[:, 1] - runs[:, 0] >= min_length]
    runs[:, 0], runs[:, 1] = source[runs[:, 0]], source[runs[:, 1] - 1] + 1
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True at each of ``n`` words that some run holds after its first period."""
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 1], -1)
    return np.cumsum(mark[:n]) > 0


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs``: its runs of at least
    ``min_length`` words by start, then period, and its words without those that
    a run repeats, joined by one space. Words are what ASCII white space parts."""

    def make():
        ids: dict[bytes, int] = {}

        def work(batch):
            import pyarrow as pa

            if len(ids) > 1 << 20:
                ids.clear()
            texts = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            x = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
            runs = runs_of(lengths, x, min_length)
            drop = dropped_words(len(x), runs)
            begin = np.concatenate(([0], np.cumsum(lengths)))
            where = np.searchsorted(runs[:, 0], begin)
            rows, kept = [], []
            for k, words in enumerate(texts):
                mine = runs[where[k]:where[k + 1]] - (begin[k], begin[k], 0)
                rows.append([{"start": s, "length": e - s, "period": q} for s, e, q in mine.tolist()])
                if len(mine):
                    words = [words[i] for i in np.flatnonzero(~drop[begin[k]:begin[k + 1]]).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            return {"doc_id": batch.column(0), "runs": rows, "collapsed": kept}

        return work

    return map_batches(keyed_text(docs), make, f"doc_id long, runs {RUN}, collapsed string")


WORDS = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every document whose crc32(doc_id as text) ends in 0, the words from
    a on repeat the p words at a. Null id: text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = keyed_text(docs).select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", WORDS), lambda w: w != "")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(
        F.col("a").cast("int") + (i - F.col("a").cast("int")) % F.col("p")))
    again = F.array_join(F.transform(place, lambda i: F.element_at("w", (i + 1).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """One row a document: the number of runs, the longest (ties: smallest start, then period),
    and SHA-256 of the list of runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("q"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = runs.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = -F.col("best.l"), F.col("best.q")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("(1000 * -best.l) div best.q").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
