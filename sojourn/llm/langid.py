"""Operator 2, language ID by hierarchical discrimination.

A text is described by the frequencies of its hashed letter trigrams (word ends
included). A linear support vector machine first tells the language family
(one-versus-one when there are more than two), then one-versus-one machines
separate the languages within that family. Training: dual coordinate descent
(squared hinge) in numpy on a bounded sample of the training fold; prediction:
one dot product per machine over the whole text.

Edge cases. Null text, or text without any letter: ``und``, score 0. Null id: not
held out (its fold is unknown), not learned from. Null or empty lang: not learned
from. Repeated rows: each is scored; of an id's rows one is learned from. A language outside FAMILIES is a family of
its own. Only one language learned: always that, score 1. None learned: ``und``.
Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, keyed_text, map_batches
from .crf_quality import fold
from .text_arrays import code_points, letters, sums

#: Languages of the families that are told apart first.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"),
            "romance": ("fr", "es", "it", "pt", "ro", "ca"),
            "slavic": ("ru", "pl", "cs", "uk", "bg", "sr")}
#: Hash size of trigrams, and bound of the training sample per language.
BITS = 15
SAMPLE_PER_LANGUAGE = 1500


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the trigram that ends at each code point, whether it counts,
    end of each text). Case is folded, what is no letter is one word boundary;
    a trigram counts if its middle or last sign is a letter."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in lowered), dtype=np.int64, count=len(lowered)))
    cp = code_points("  ".join(lowered) + "  ") if lowered else np.empty(0, np.uint32)
    letter = letters()[cp]
    c = np.where(letter, cp, 0).astype(np.uint32)
    b, a = np.zeros_like(c), np.zeros_like(c)
    b[1:], a[2:] = c[:-1], c[:-2]
    h = c * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + a * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS), letter | (b > 0), ends


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 10.0,
              epochs: int = 12) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, by dual
    coordinate descent; ``rows``: (indices, values), ``y``: +1 or -1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    rng = np.random.default_rng(0)
    share = {s: max((y == s).sum(), 1) for s in (1, -1)}
    cost = {s: 0.5 / (c * len(y) / (2 * share[s])) for s in (1, -1)}
    norm = [float(v @ v) + 1 for _, v in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1 + cost[y[i]] * alpha[i]
            new = max(alpha[i] - g / (norm[i] + cost[y[i]]), 0.0)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[at] += d * v
                w[-1] += d
                alpha[i] = new
    return w


def vote(margins: dict[tuple, np.ndarray], names: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one: index of the name with most won duels (ties: the larger sum
    of margins, then the earlier name), and the mean probability of its duels."""
    if len(names) == 1:
        return np.zeros(n, dtype=int), np.ones(n)
    wins, total, prob = (np.zeros((n, len(names))) for _ in range(3))
    for (i, j), m in margins.items():
        p = 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        for k, won, gain, pk in ((i, m >= 0, m, p), (j, m < 0, -m, 1 - p)):
            wins[:, k] += won
            total[:, k] += np.tanh(gain)
            prob[:, k] += pk / (len(names) - 1)
    best = np.argmax(wins + total / (4 * len(names)), axis=1)
    return best, prob[np.arange(n), best]


def train_model(rows: list, langs: list[str]) -> dict | None:
    """Weights of every machine: {"families": [...], "langs": {family: [...]},
    "duels": [(family or None, i, j)], "w": machines x (features + 1)}."""
    known = sorted(set(langs))
    if not known:
        return None
    families = sorted({family_of(k) for k in known})
    model = {"families": families, "langs": {f: [k for k in known if family_of(k) == f] for f in families}}
    duels, weights = [], []
    for level in (None, *families):
        names = families if level is None else model["langs"][level]
        of = family_of if level is None else (lambda k: k)
        for i, j in combinations(range(len(names)), 2):
            at = [k for k, g in enumerate(langs) if of(g) in (names[i], names[j])]
            y = np.array([1 if of(langs[k]) == names[i] else -1 for k in at])
            duels.append((level, i, j))
            weights.append(train_svm([rows[k] for k in at], y, 1 << BITS))
    model["duels"] = duels
    model["w"] = np.array(weights, dtype=np.float32).reshape(-1, (1 << BITS) + 1)
    return model


def predict(texts: list[str], model: dict | None) -> tuple[list[str], np.ndarray]:
    """(language, score) of each whole text."""
    n = len(texts)
    h, use, ends = trigrams(texts)
    has = sums(letters()[code_points("".join(texts))].astype(np.uint8),
               np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=n))) > 0 if n else np.empty(0, bool)
    lang, score = np.array(["und"] * n, dtype=object), np.zeros(n)
    if model is None or not n:
        return list(lang), score
    grams = np.maximum(sums(use.astype(np.uint8), ends), 1)
    margin = {}
    for (level, i, j), w in zip(model["duels"], model["w"]):
        margin.setdefault(level, {})[i, j] = SCALE * sums(np.where(use, w[h], np.float32(0)), ends) / grams + w[-1]
    family, p_family = vote(margin.get(None, {}), model["families"], n)
    for f, name in enumerate(model["families"]):
        names = model["langs"][name]
        best, p = vote(margin.get(name, {}), names, n)
        at = np.flatnonzero((family == f) & has)
        lang[at] = np.array(names, dtype=object)[best[at]]
        score[at] = np.clip(p_family[at] * p[at], 0, 1)
    return list(lang), score


#: Frequencies are multiplied by this before training (and so in prediction).
SCALE = 30.0


def fit(docs: DataFrame, folds: int = 3, held_out: int = 1) -> dict | None:
    """Train on about SAMPLE_PER_LANGUAGE documents of each language (those with
    a small hash of their id), outside the held-out fold; text, lang only."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("text").isNotNull() & (F.col("lang") != "") & F.col("doc_id").isNotNull()
                        & (fold(folds) != held_out))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (u < int(1_000_000 * min(1, SAMPLE_PER_LANGUAGE / n))))

    def make():
        def work(batch):
            texts = batch.column(1).to_pylist()
            h, use, ends = trigrams(texts)
            out, at = [], 0
            for end in ends:
                k, n = np.unique(h[at:end][use[at:end]], return_counts=True)
                out.append(k.astype("<i4").tobytes() + (n * (SCALE / max(n.sum(), 1))).astype("<f4").tobytes())
                at = end
            return {"lang": batch.column(2), "row": out}

        return work

    # of an id's rows one: the sample is bounded by ids
    one = known.where(wanted).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.text", "r.lang")
    rows = map_batches(one, make, "lang string, row binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["row"])))
    vectors = [(np.frombuffer(b[:len(b) // 2], "<i4"), np.frombuffer(b[len(b) // 2:], "<f4").astype(float))
               for b in (bytes(r["row"]) for r in rows)]
    return train_model(vectors, [r["lang"] for r in rows])


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    model = fit(docs, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines x 2^BITS weights

    def make():
        def work(batch):
            lang, score = predict(batch.column(1).to_pylist(), shared.value)
            return {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

        return work

    out = map_batches(keyed_text(docs), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(folds) == held_out).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) with a language, told with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        def keep(texts):
            lang, score = predict(texts, shared.value)
            return [k != "und" and s >= min_score for k, s in zip(lang, score)]

        return keep

    return filter_rows(docs, make)
