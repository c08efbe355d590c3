"""Operator 9, quality classifier: a linear-chain conditional random field
labels every line of a document good or bad.

A line's state features are its own and those of the lines before and after it;
the chain's transition scores tie the labels of neighbouring lines. Training
(conditional likelihood, numpy) takes the document's label for each of its lines,
on a bounded sample of labelled documents outside the held-out fold. Every text
is then scored whole: forward-backward marginals of "good", weighted by line
length, sum to the document's quality.

Two-label chains allow the recursions in log-odds form: ``forward[t]`` is the
log-odds of good against bad given the lines up to t, ``backward[t]`` the same
for the lines after t, and the marginal is sigmoid(forward + backward).

Edge cases. Null or empty text: one empty line, scored like any other. Null
id or label: never in the sample; scored, not held out. Repeated rows: each is
scored; of several texts of one id the smallest is learned from. Several labels of one id: the
smallest counts. Every line learns its document's label, so the transition scores mostly say "stay". Without any usable label the
score is 0.5. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, keyed_text, map_batches
from .text_arrays import code_points, letters, sums, uppers

#: Training cuts chains into pieces of so many lines.
CHAIN = 32
#: Bounds of the training sample: documents, and pieces of one document (those with the
#: smallest hash of id and place, from the whole text).
SAMPLE_DOCS, SAMPLE_PIECES = 4000, 8
FEATURES = 13


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, length per line, lines per text)."""
    from operator import eq

    lines, per_text = [], np.empty(len(texts), dtype=np.int64)
    repeats = []
    for k, text in enumerate(texts):
        own = text.split("\n")
        per_text[k] = len(own)
        lines += own
        seen = set()
        for line in own:
            repeats.append(line in seen)
            seen.add(line)
    n = len(lines)
    length = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    cp = code_points("\n".join(lines) + "\n")
    ends = np.cumsum(length + 1)
    letter, upper = letters()[cp], uppers()[cp]
    space = (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13)
    digit = (cp >= 48) & (cp <= 57)
    symbol = ~(letter | space | digit)
    pair = np.zeros(len(cp), dtype=bool)
    pair[1:] = symbol[1:] & symbol[:-1]
    count = lambda x: sums(x.astype(np.uint8), ends).astype(np.float64)
    n_letter, n_symbol = count(letter), count(symbol)
    words, same, distinct = np.empty(n), np.empty(n), np.empty(n)
    for k, line in enumerate(lines):
        w = line.split()
        words[k] = len(w)
        same[k] = sum(map(eq, w, w[1:]))
        distinct[k] = len(set(w))
    one, some = np.maximum(words, 1), np.maximum(length, 1)
    x = np.empty((n, FEATURES), dtype=np.float32)
    x[:, 0] = count(upper) / np.maximum(n_letter, 1)
    x[:, 1] = n_symbol / some
    x[:, 2] = np.minimum(count(pair) / one, 3)
    x[:, 3] = np.minimum(count(cp == 124) / one, 2)
    x[:, 4] = np.minimum(count(cp == 33) / one, 2)
    x[:, 5] = same / np.maximum(words - 1, 1)
    x[:, 6] = distinct / one
    x[:, 7] = count(digit) / some
    x[:, 8] = np.log1p(length)
    x[:, 9] = np.minimum(n_letter / one, 40) / 10
    x[:, 10] = words < 4
    x[:, 11] = np.asarray(repeats, dtype=np.float32) * (length > 0)
    x[:, 12] = length == 0
    return x, length, per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after in the same text."""
    first = np.zeros(len(x), dtype=bool)
    ends = np.cumsum(per_text)
    first[ends - per_text] = True
    last = np.zeros(len(x), dtype=bool)
    last[ends - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.concatenate([x, before, after, first[:, None], last[:, None]], axis=1).astype(np.float32)


def _step(odds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next label before its own evidence; t[i, j]: from i to j (1 = good)."""
    return np.logaddexp(odds + t[1, 1], t[0, 1]) - np.logaddexp(odds + t[1, 0], t[0, 0])


def chain_odds(evidence: np.ndarray, per_text: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with own evidence) and backward (without) log-odds of each line
    of many chains laid end to end; all chains advance together."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    sizes, starts = per_text[order], starts[order]
    forward, backward = evidence.astype(np.float64), np.zeros(len(evidence))
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    for k in range(1, len(alive)):
        at = starts[:alive[k]] + k
        forward[at] += _step(forward[at - 1], t)
    for k in range(1, len(alive)):
        at = starts[:alive[k]] + sizes[:alive[k]] - 1 - k
        backward[at] = _step(evidence[at + 1] + backward[at + 1], t.T)
    return forward, backward


def train(x: np.ndarray, y: np.ndarray, per_text: np.ndarray, steps: int = 250, l2: float = 1e-3) -> dict:
    """Maximise the conditional likelihood of the line labels by Adam. Both
    labels weigh the same in total."""
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate([(x - mean) / std, np.ones((len(x), 1))], axis=1).astype(np.float32)
    last = np.cumsum(per_text) - 1
    inner = np.ones(len(x), dtype=bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    share = max(y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6))
    w, t = np.zeros(z.shape[1]), np.zeros((2, 2))
    m = np.zeros(len(w) + 4)
    v = np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        e = z @ w
        f, b = chain_odds(e, per_text, t)
        good = 1 / (1 + np.exp(-np.clip(f + b, -50, 50)))
        gw = z.T @ (weight * (good - y)) / len(y) + l2 * w
        gt = l2 * t
        if len(at):
            right = e[at + 1] + b[at + 1]
            joint = np.stack([np.zeros(len(at)) + t[0, 0], t[0, 1] + right, t[1, 0] + f[at], t[1, 1] + f[at] + right])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            seen = (2 * y[at] + y[at + 1]).astype(int)
            joint[seen, np.arange(len(at))] -= 1
            gt = gt + ((joint * weight[at]).sum(1) / len(y)).reshape(2, 2)
        g = np.concatenate([gw, gt.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w, t = w - step[:-4], t - step[-4:].reshape(2, 2)
    return {"mean": mean, "std": std, "w": w, "t": t}


def quality(texts: list[str], model: dict | None) -> np.ndarray:
    """Quality of each text: length-weighted mean of its lines' marginals."""
    if model is None:
        return np.full(len(texts), 0.5)
    x, length, per_text = line_features(texts)
    z = (with_neighbours(x, per_text) - model["mean"]) / model["std"]
    f, b = chain_odds(z @ model["w"][:-1] + model["w"][-1], per_text, model["t"])
    good = 1 / (1 + np.exp(-np.clip(f + b, -50, 50)))
    weight, ends = length + 1.0, np.cumsum(per_text)
    return np.clip(sums(weight * good, ends) / sums(weight, ends), 0, 1)


def fold(folds: int):
    """crc32 of the id as text, modulo ``folds``; null id: -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))


def pieces(doc_id: int, lines: int) -> list[int]:
    """The pieces of CHAIN lines of a document that training reads, in order."""
    k = np.arange(-(-lines // CHAIN), dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.int64(doc_id).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return sorted(np.argsort(h, kind="stable")[:SAMPLE_PIECES].tolist())


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> dict | None:
    """Train on at most SAMPLE_DOCS labelled documents outside the held-out
    fold: those with the smallest hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()  # bounded
    ids = {r["doc_id"]: r["label"] for r in sample}
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    texts = docs.join(F.broadcast(wanted), "doc_id", "left_semi")  # at most SAMPLE_DOCS ids
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # of an id's rows, one

    def make():
        def work(batch):
            ids = batch.column(0).to_pylist()
            x, _, per_text = line_features(batch.column(1).to_pylist())
            x = with_neighbours(x, per_text)
            at = np.cumsum(per_text) - per_text
            return {"doc_id": ids, "lines": [b"".join(x[a + CHAIN * k:a + min(n, CHAIN * (k + 1))].tobytes() for k in pieces(i, n))
                                             for i, a, n in zip(ids, at, per_text)]}

        return work

    rows = map_batches(texts, make, "doc_id long, lines binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    xs, ys, chains = [], [], []
    for r in rows:
        x = np.frombuffer(r["lines"], dtype=np.float32).reshape(-1, 3 * FEATURES + 2)
        xs.append(x)
        ys.append(np.full(len(x), ids[r["doc_id"]]))
        chains += [min(CHAIN, len(x) - a) for a in range(0, len(x), CHAIN)]
    if not xs or len(set(ids.values())) < 2:
        return None
    return train(np.concatenate(xs), np.concatenate(ys), np.asarray(chains))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit(keyed_text(docs), labels, folds, held_out)

    def make():
        return lambda batch: {"doc_id": batch.column(0), "score": quality(batch.column(1).to_pylist(), model)}

    scored = map_batches(keyed_text(docs), make, "doc_id long, score double")
    return scored.select("doc_id", (fold(folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``threshold``; all columns."""
    model = fit(keyed_text(docs), labels)

    def make():
        return lambda texts: quality(texts, model) >= threshold

    return filter_rows(docs, make)
