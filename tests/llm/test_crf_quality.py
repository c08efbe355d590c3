import itertools
import zlib

import numpy as np

from sojourn.llm import crf_quality as q

from .helpers import docs_frame, odd_rows


def test_marginals_equal_the_sum_over_all_labelings():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 3, 1])
    e, t = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    f, b = q.chain_odds(e, lengths, t)
    got, at = 1 / (1 + np.exp(-(f + b))), 0
    for n in lengths:
        weight = {y: np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
                  for y in itertools.product((0, 1), repeat=int(n))}
        for k in range(n):
            want = sum(w for y, w in weight.items() if y[k]) / sum(weight.values())
            assert abs(got[at + k] - want) < 1e-9
        at += n


def test_training_moves_labels_apart_and_uses_neighbours():
    texts = ["good line of words\n" * 5, "bad!! bad!! ###\n" * 5] * 20
    x, _, n = q.line_features(texts)
    z = q.with_neighbours(x, n)
    assert z.shape == (n.sum(), 3 * q.FEATURES + 2)
    assert np.array_equal(z[1, q.FEATURES:2 * q.FEATURES], x[0]) and not z[0, q.FEATURES:2 * q.FEATURES].any()
    y = np.repeat(np.tile([1, 0], 20), n)
    score = q.quality(texts[:2], q.train(z, y, n))
    assert score[0] > 0.9 and score[1] < 0.1


def corpus(spark, n=120):
    good, bad = "A line of plain words, then more.\nAnd another one follows here.", "BAD!! LINE!! $$$\nx | y | z | ###"
    docs = [(i, (good if i % 3 else bad) + f"\nnumber {i}") for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0, "x") for i in range(n)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (7, 1, 1, "x")]
    return docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_scores(spark):
    docs, labels = corpus(spark)
    for r in q.score(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] % 3 > 0)
    assert sorted(r["doc_id"] % 3 for r in q.accepted(docs, labels).collect())[0] == 1


def test_held_out_labels_are_never_learned(spark):
    docs, labels = corpus(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(q.fold(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(q.score(docs, labels).collect()) == sorted(q.score(docs, flipped).collect())


def test_odd_rows(spark):
    _, labels = corpus(spark)
    rows = q.score(docs_frame(spark, odd_rows()), labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in odd_rows())
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert q.score(docs_frame(spark, []), labels).collect() == []
    assert {r["score"] for r in q.score(docs_frame(spark, odd_rows()), labels.limit(0)).collect()} == {0.5}


def test_training_reads_pieces_of_the_whole_text():
    assert q.pieces(7, 100) == [0, 1, 2, 3] and q.pieces(7, 1) == [0]
    chosen = [q.pieces(i, 32 * 100) for i in range(40)]
    assert all(len(set(c)) == q.SAMPLE_PIECES and c == sorted(c) for c in chosen)
    assert 40 < np.mean([k for c in chosen for k in c]) < 60  # no prefix


def test_long_texts_and_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    seen = {}

    def train(x, y, chains, *more):
        seen.update(lines=len(x), chains=len(chains), labels=np.bincount(y).tolist())
        return {"mean": x.mean(0), "std": x.std(0) + 1, "w": np.zeros(x.shape[1] + 1), "t": np.zeros((2, 2))}

    monkeypatch.setattr(q, "train", train)
    long = "\n".join(f"line {k} of the text" for k in range(1000))
    docs = [(1, long)] + [(2, f"one line {k % 3}") for k in range(10_000)] + [(4, "bad\nbad")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "doc_id long, quality int")
    assert {i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 5} == {1, 2, 4}
    assert q.score(docs_frame(spark, docs), labels).count() == len(docs)
    assert seen["labels"][0] == 2 and seen["lines"] <= q.SAMPLE_PIECES * q.CHAIN + 1 + 2 and seen["lines"] > 200


def test_accepted_of_odd_rows_and_no_rows(spark):
    docs, labels = corpus(spark)
    odd = docs_frame(spark, odd_rows())
    kept = q.accepted(odd, labels)
    assert kept.columns == odd.columns
    want = [r["doc_id"] for r in q.score(odd, labels).where("predicted = 1").collect()]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))
    assert q.accepted(docs_frame(spark, []), labels).count() == 0
