from collections import Counter

import numpy as np
import pytest

from sojourn.llm import pll

from .helpers import docs_frame, odd_rows


def test_log_probs_sum_to_one_and_never_see_the_token():
    p = pll.unpack(pll.fresh())
    ids = np.array([0, 0, 5, 9, 7, 0, 0], dtype=np.int32)
    total = 0.0
    for k in range(pll.VOCABULARY):
        ids[3] = k
        total += np.exp(pll.log_probs(p, ids, np.array([3]))[0])
    assert abs(total - 1) < 1e-4


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    ids, at = rng.integers(0, pll.VOCABULARY, 40).astype(np.int32), np.arange(2, 38)
    vector = pll.fresh()
    learner = pll.Learner(vector)
    learner.learn(ids, at)
    g = learner.m / 0.1  # the first step's gradient
    loss = lambda v: -pll.log_probs(pll.unpack(v), ids, at).mean()
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 12, replace=False):
        up, down = vector.astype(np.float64), vector.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[k]) < 1e-3


def test_words_as_str_split_cuts_them():
    texts = ["", " ", "a", "The CAT\tsat\x0bon\u00a0it\n", "x1 12 $$$ été, don't ÀÉ!", "\x1c\u3000z", "no  one  two "]
    h, bucket, n = pll.words_in(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    same = {}
    for w, x, b in zip(words, h.tolist(), bucket.tolist()):
        assert same.setdefault(w, (x, b)) == (x, b)
    assert len({x for x, _ in same.values()}) == len(same)
    again = {w: (int(x), int(b)) for w in same for x, b in [[v[0] for v in pll.words_in([w])[:2]]]}
    assert again == same
    assert [same[w][1] // pll.ENDINGS for w in ("cat", "12", "$$$", "été,", "don't", "x1")] == [0, 2, 1, 0, 3, 2]


def corpus(spark, n=400):
    return docs_frame(spark, [(i, "one two three four five six seven eight " * (40 + i % 50)) for i in range(n)])


def test_order_is_learned(spark):
    frequent, encoded = pll.encoded_texts(pll.keyed_text(corpus(spark)))
    vector = pll.fit(encoded)
    assert set(frequent) == {"one", "two", "three", "four", "five", "six", "seven", "eight"}
    rng = np.random.default_rng(1)
    words = ("one two three four five six seven eight " * 5).split()

    def mean(w):
        ids, n = pll.bordered(pll.encode([" ".join(w)], pll.Words(frequent)))
        return pll.log_probs(pll.unpack(vector), ids, pll.places(n)).mean()

    assert mean(words) > mean(list(rng.permutation(words))) + 1


def test_vocabulary_counts_all_texts(spark, monkeypatch):
    monkeypatch.setattr(pll, "MAX_COUNTS", 2)
    monkeypatch.setattr(pll, "WORDS", 3)
    docs = docs_frame(spark, [(1, "a b c d"), (2, "B c d"), (3, None), (4, "c D e")])
    assert pll.vocabulary(pll.keyed_text(docs)) == ["c", "d", "b"]


def test_odd_rows(spark):
    rows = pll.score(docs_frame(spark, odd_rows())).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), len((t or "").split())) for i, t in odd_rows())
    for r in rows:
        assert r["log_prob"] < 0 if r["n_tokens"] else r["log_prob"] == 0 and r["mean_log_prob"] is None
    same = [r["log_prob"] for r in rows if r["doc_id"] in (1, 6)]
    assert len(same) == 3 and max(same) - min(same) < 1e-6
    assert pll.score(docs_frame(spark, [])).collect() == []


def test_word_within_its_bucket_counts(spark, monkeypatch):
    """Two words of one bucket: a document's score holds each word's share of the bucket."""
    monkeypatch.setattr(pll, "BLOCK", 4)  # several blocks
    monkeypatch.setattr(pll, "SHARD", 2)  # and shards
    frequent = " ".join(f"f{k}" for k in range(pll.WORDS)) + " "
    (_, bucket, _) = pll.words_in(["wazb xazb yazb q12"])
    assert bucket[0] == bucket[1] == bucket[2] != bucket[3]
    rows = [(0, frequent * 9), (1, "wazb"), (2, "xazb"), (3, "xazb xazb q12"), (4, "yazb"), (5, ""), (6, "xazb xazb xazb")]
    got = {r["doc_id"]: r["log_prob"] for r in pll.score(docs_frame(spark, rows)).collect()}
    n = {"wazb": 1, "xazb": 6, "yazb": 1}
    assert abs(got[2] - got[1] - np.log(n["xazb"] / n["wazb"])) < 1e-5  # same class, other word
    assert abs(got[4] - got[1]) < 1e-5 and got[5] == 0

    _, blocks = pll.encoded_blocks(pll.keyed_text(docs_frame(spark, rows)))
    at = {(r["block"], r["place"]): r["doc_id"] for r in blocks.where("tokens is not null").collect()}
    within = {at[r["block"], r["place"]]: r["within"] for r in pll.within_classes(blocks).collect()}
    share = {w: np.log(c / 8) for w, c in n.items()}
    want = {0: 0, 1: share["wazb"], 2: share["xazb"], 3: 2 * share["xazb"], 4: share["yazb"], 5: 0, 6: 3 * share["xazb"]}
    assert within.keys() == want.keys() and all(abs(within[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("leaf,depth", [(64, 0), (1, 2)])
def test_whole_scores_equal_one_token_at_a_time(spark, monkeypatch, leaf, depth):
    """Weights that are not trained, so that nothing is near zero; every token by itself."""
    monkeypatch.setattr(pll, "LEAF", leaf)
    rng = np.random.default_rng(5)
    vector = rng.normal(scale=0.3, size=pll.SIZE).astype(np.float32)
    nodes = rng.normal(scale=0.5, size=(pll.BUCKETS << depth, pll.HIDDEN)).astype(np.float32) if depth else np.zeros((0, 16), np.float32)
    monkeypatch.setattr(pll, "fit", lambda encoded, totals: np.concatenate((vector, nodes.ravel())))
    vocabulary = [f"w{k}" for k in range(150)] + ["".join(rng.choice(list("abcxyz"), 5)) for _ in range(250)] + ["12", "$$", "Été,"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(60)] + ["", "a", "w1 W1 w1"]
    rows = list(enumerate(texts)) + [(100, None), (3, texts[3])]
    docs = docs_frame(spark, rows)
    frequent = pll.vocabulary(pll.keyed_text(docs))
    assert len(frequent) == pll.WORDS < len({w for t in texts for w in t.lower().split()})
    words, p = pll.Words(frequent), pll.unpack(vector.astype(np.float64))

    class_of = lambda text: list(pll.encode([text], words)[0])
    code = {w: int(pll.codes_of(pll.words_in([w])[0], depth)[0]) for _, t in rows for w in (t or "").lower().split()}
    assert not depth or len(set(code.values())) == 1 << depth == 1 << pll.depth_of(len(code))
    of_word, below = Counter(), Counter()  # tokens of each word; and below each node, by class and the bits that lead to it
    for _, t in rows:
        of_word.update((t or "").lower().split())
        for w, c in zip((t or "").lower().split(), class_of(t or "")):
            below.update((c, f"{code[w]:0{depth}b}"[:k]) for k in range(depth + 1))

    def in_class(word, c, h):
        """log P(word | class, hidden values)."""
        if c <= pll.WORDS:
            return 0.0
        out, bits = 0.0, f"{code[word]:0{depth}b}" if depth else ""
        for k, bit in enumerate(bits):
            zero, one = below[c, bits[:k] + "0"], below[c, bits[:k] + "1"]
            odds = np.log(one / zero) if one and zero else 30.0 if one else -30.0
            z = odds + h @ nodes[((c - 1 - pll.WORDS) << depth) + int("1" + bits[:k], 2)].astype(np.float64)
            out -= np.log1p(np.exp(-z if bit == "1" else z))
        return out + np.log(of_word[word] / below[c, bits])

    for r in pll.score(docs).collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        ids, want = [0, 0, *class_of(text), 0, 0], 0.0
        for i, word in enumerate(text.lower().split(), 2):
            h = np.tanh(p["b"] + sum(p["e"][k][ids[i + o]] for k, o in enumerate((-2, -1, 1, 2))))
            q = h @ p["w"] + p["c"]
            want += q[ids[i]] - np.log(np.exp(q).sum()) + in_class(word, ids[i], h)
        assert abs(r["log_prob"] - want) <= 1e-4 * max(1, abs(want)), text[:40]


def test_trees_are_a_distribution_and_untrained_give_shares():
    rng = np.random.default_rng(2)
    totals = rng.integers(0, 5, pll.BUCKETS * 8)
    totals[8:12] = 0  # half a tree without tokens
    weights = rng.normal(size=(len(totals), pll.HIDDEN)).astype(np.float32)
    codes = np.arange(8, dtype=np.uint8)
    for bucket in (0, 1, 2, pll.BUCKETS - 1):
        ids, share = np.full(8, 1 + pll.WORDS + bucket, np.uint8), totals[8 * bucket:8 * bucket + 8]
        for trees, h in ((pll.Trees(totals, weights), rng.normal(size=(1, pll.HIDDEN))), (pll.Trees(totals, 0 * weights), np.ones((1, pll.HIDDEN)))):
            which, rows, right = trees.paths(ids, codes, np.arange(8))
            assert which.tolist() == list(range(8))
            p = np.exp(trees.log_probs(np.repeat(h, 8, 0).astype(np.float32), rows, right))
            assert abs(p.sum() - 1) < 1e-5
        assert np.allclose(p, share / share.sum(), atol=1e-5)
    assert pll.Trees(totals, weights).paths(np.array([0, 5, pll.WORDS]), codes, np.arange(3))[0].size == 0


def test_gradient_with_trees_by_differences():
    rng = np.random.default_rng(3)
    ids, at = rng.integers(1, pll.VOCABULARY, 60).astype(np.uint8), np.arange(2, 58)
    codes = np.where(ids > pll.WORDS, rng.integers(0, 4, 60), 0).astype(np.uint8)
    totals = rng.integers(1, 9, pll.BUCKETS * 4)
    nodes = rng.normal(scale=0.5, size=(len(totals), pll.HIDDEN)).astype(np.float32)
    vector = np.concatenate((pll.fresh(), nodes.ravel()))

    def loss(v):
        return -pll.log_probs(pll.unpack(v), ids, at, pll.Trees(totals, v[pll.SIZE:]), codes).mean()

    def slope(k):
        up, down = vector.astype(np.float64), vector.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        return (loss(up) - loss(down)) / 2e-4

    learner = pll.Learner(vector, totals)
    learner.learn(ids, at, codes)
    g = learner.m / 0.1
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 12, replace=False):
        assert abs(slope(k) - g[k]) < 1e-3
    moved = nodes - learner.trees.weights
    met = np.flatnonzero(np.abs(moved).sum(1))
    assert 0 < len(met) < len(nodes)
    for row in rng.choice(met, 6, replace=False):  # a node's first step is along its gradient, 0.2 long
        want = np.array([slope(pll.SIZE + row * pll.HIDDEN + k) for k in range(pll.HIDDEN)])
        assert np.allclose(moved[row], 0.2 * want / np.linalg.norm(want), atol=4e-3)


def test_window_tells_words_of_a_bucket_apart(spark, monkeypatch):
    """Words of one bucket, each after a word of its own: trained trees know which one comes."""
    monkeypatch.setattr(pll, "LEAF", 1)
    monkeypatch.setattr(pll, "WORDS", 2)
    monkeypatch.setattr(pll, "depth_of", lambda distinct: 4)
    h, bucket, _ = pll.words_in(["wazb xazb"])
    assert bucket[0] == bucket[1] and (codes := pll.codes_of(h, 4))[0] != codes[1]
    rows = [(i, "left wazb right xazb " * (40 + i % 7)) for i in range(900)]
    rows += [(1000, "left wazb right xazb " * 5), (1001, "left xazb right wazb " * 5)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in pll.score(docs_frame(spark, rows)).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 0.2
