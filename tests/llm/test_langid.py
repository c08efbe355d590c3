import math
import zlib
from collections import Counter

import numpy as np

from sojourn.llm import langid

from .helpers import docs_frame, odd_rows

WORDS = {"en": "the and thing other with from that ing tion er", "de": "der und schicht ung keit lich für über das nicht",
         "fr": "le la que être ment avec dans pour une eau", "es": "el los que ción para con mente por año una"}


def corpus(spark, n=160):
    rng, rows = np.random.default_rng(0), []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rows_are_told_and_folds_fixed(spark):
    docs = corpus(spark)
    rows = langid.identify(docs).collect()
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == len(want)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] == want[r["doc_id"]] and 0.5 < r["score"] <= 1


def test_held_out_lang_is_never_learned(spark):
    docs = corpus(spark)
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(wrong).collect())


def test_family_first_then_language():
    rows, langs = [], []
    for k, lang in enumerate(WORDS):
        for i in range(12):
            text = " ".join(np.random.default_rng(100 * k + i).choice(WORDS[lang].split(), 30))
            h, use, _ = langid.trigrams([text])
            at, n = np.unique(h[use], return_counts=True)
            rows.append((at.astype(int), n * langid.SCALE / n.sum()))
            langs.append(lang)
    model = langid.train_model(rows, langs)
    assert model["families"] == ["germanic", "romance"] and [d[0] for d in model["duels"]] == [None, "germanic", "romance"]
    assert langid.predict(["THE THING AND THE OTHER"], model)[0] == ["en"]


def test_odd_rows_and_one_language(spark):
    rows = langid.identify(docs_frame(spark, odd_rows())).collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in rows)
    assert got == sorted((str(i), "en" if any(c.isalpha() for c in t or "") else "und") for i, t in odd_rows())
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in rows)
    kept = langid.accepted(docs_frame(spark, odd_rows()))
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in odd_rows()) and "_own" in kept.columns


def test_nothing_to_learn(spark):
    assert langid.identify(docs_frame(spark, [])).collect() == []
    rows = langid.identify(docs_frame(spark, odd_rows(), lang=None)).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and len(rows) == len(odd_rows())


def test_an_id_repeated_in_most_rows_is_learned_from_once(spark, monkeypatch):
    seen = []
    train = langid.train_model
    monkeypatch.setattr(langid, "train_model", lambda rows, langs: seen.append(len(rows)) or train(rows, langs))
    docs = corpus(spark)
    some = docs.where("doc_id = 3").limit(1)
    many = docs.unionAll(some.crossJoin(spark.range(3000)).select(docs.columns))
    langid.fit(many)
    assert seen[0] <= docs.count()


def plain_prediction(text, model):
    """One text at a time: its gram frequencies, a dot product a machine, duels counted in dictionaries."""
    h, use, _ = langid.trigrams([text])
    counts = Counter(h[use].tolist())
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    total = sum(counts.values())
    margin = {duel: float(w[-1]) + sum(float(w[g]) * langid.SCALE * n / total for g, n in counts.items())
              for duel, w in zip(model["duels"], model["w"])}

    def winner(level, names):
        if len(names) == 1:
            return names[0], 1.0
        won, prob = Counter(), Counter()
        for (of, i, j), m in margin.items():
            if of == level:
                p = 1 / (1 + math.exp(-3 * m))
                won[i if m >= 0 else j] += 1
                prob[i] += p / (len(names) - 1)
                prob[j] += (1 - p) / (len(names) - 1)
        best = max(won, key=lambda k: won[k])
        assert sum(n == won[best] for n in won.values()) == 1  # the sample has no tie
        return names[best], prob[best]

    family, p = winner(None, model["families"])
    lang, q = winner(family, model["langs"][family])
    return lang, p * q


def test_predictions_equal_one_text_at_a_time(spark):
    rows = corpus(spark, 80).collect()
    vectors = []
    for r in rows:
        h, use, _ = langid.trigrams([r["text"]])
        k, n = np.unique(h[use], return_counts=True)
        vectors.append((k, n * langid.SCALE / n.sum()))
    model = langid.train_model(vectors, [r["lang"] for r in rows])
    texts = [r["text"] for r in rows[:30]] + ["the und que los", "x", "ünï 漢字", "", "12 34", "der " * 3000, "The AND Thing"]
    lang, score = langid.predict(texts, model)
    for t, got, s in zip(texts, lang, score):
        want, p = plain_prediction(t, model)
        assert got == want and abs(s - p) < 1e-3, t[:40]


def test_solver_reaches_the_optimum():
    """The weights of the squared-hinge machine leave no slope of its own objective."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0.4, 1, -1)
    c = 1.0
    w = langid.train_svm([(np.arange(8), r) for r in x], y, 8, c=c, epochs=4000)
    share = {s: (y == s).sum() for s in (1, -1)}
    weight = np.array([1 / (2 * (0.5 / (c * 60 / (2 * share[s])))) for s in y.tolist()])
    one = np.hstack([x, np.ones((60, 1))])
    slack = np.maximum(0, 1 - y * (one @ w))
    slope = w - 2 * (weight * slack * y) @ one
    assert np.abs(slope).max() < 1e-3
