"""MinHash near-dedup against the Jaccard similarity of every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.llm import minhash, queries

from .helpers import docs_frame, odd_rows


def shingles(text):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
    return frozenset(zip(words, words[1:])) if len(words) != 1 else frozenset(words)


def brute(rows):
    """{(doc_id, n, component, kept)}: every pair compared."""
    sets = {s: None for _, t in rows if (s := shingles(t))}
    names = list(sets)
    parent = {s: s for s in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for doc, text in rows:
        if (s := shingles(text)) and doc is not None:
            least[root(s)] = min(doc, least.get(root(s), doc))
    out = []
    for doc, text in rows:
        s = shingles(text)
        c = least.get(root(s)) if s else doc
        out.append((doc, len(s), c, doc is not None and doc == c))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def changed(rnd, words, n):
    words = list(words)
    for k in rnd.sample(range(len(words)), n):
        words[k] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(words)


def test_classes_equal_all_pairs(spark):
    rnd = random.Random(3)
    rows = list(odd_rows())
    for group in range(12):  # texts at many distances, chains among them
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([8, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            rows.append((1000 + len(rows), changed(rnd, words, rnd.randrange(0, 1 + len(words) // 12))))
            if rnd.random() < .5:
                words = rows[-1][1].split()
    rows += [(k, rows[-1][1]) for k in range(5000, 5040)]  # copies
    rnd.shuffle(rows)
    assert got(minhash.near_duplicates(docs_frame(spark, rows))) == brute(rows)


def test_a_bucket_of_several_classes_loses_no_link(spark, monkeypatch):
    """One minhash a sub-key: buckets are far too wide, so a leader is mostly the wrong partner;
    salts of two rows."""
    monkeypatch.setattr(minhash, "SALT_ROWS", 2)
    rnd = random.Random(5)
    head = [f"h{k}" for k in range(40)]
    rows = []
    for group in range(15):
        words = head + [f"g{group}x{k}" for k in range(60)]
        rows += [(len(rows) + k, changed(rnd, words, k % 4)) for k in range(6)]
    docs = docs_frame(spark, rows)
    prints = minhash.prints(docs, 6, 1)
    by_sub = {}
    for r in prints.collect():
        for place, sub in enumerate(r["subs"]):
            by_sub.setdefault((place, sub), set()).add(r["doc_id"])
    assert max(map(len, by_sub.values())) > 12  # buckets hold several classes
    assert got(minhash.near_duplicates(docs, side=6, part=1)) == brute(rows)


def test_members_not_similar_to_their_leader_are_joined_by_differences(spark):
    """Copies of one text at distances around the threshold, some of them copies of such copies."""
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(words))]
    for k in range(1, 160):
        near = changed(rnd, words, rnd.choice([1, 4, 7, 9, 12]))
        rows.append((len(rows), near))
        for _ in range(rnd.choice([0, 0, 2])):
            rows.append((len(rows), changed(rnd, near.split(), rnd.choice([1, 3, 6]))))
    docs = docs_frame(spark, rows)
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    prints = minhash.prints(docs, 12, 3)
    nodes = prints.groupBy("node", "n", "subs").agg(F.min("doc_id").alias("least"))
    lead = minhash.leaders(minhash.buckets(nodes, 12))
    assert lead.groupBy("lead").count().agg(F.max("count")).first()[0] > len(rows) // 2
    pairs = lead.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    first = minhash.compared(pairs, minhash.texts_of(docs, prints, lead.select("node")), 80, True)
    unlike = first.where("not linked").count()
    assert unlike > 40 and minhash.same_lead_pairs(first, 80).count() < unlike * len(rows) / 20


def test_pairs_are_those_that_share_a_sub_key_of_both_collections(spark):
    docs = docs_frame(spark, [(k, " ".join(f"w{(k % 5) * 10 + j + (j > 17) * k}" for j in range(20))) for k in range(25)])
    rows = minhash.prints(docs, 4, 2)
    nodes = rows.groupBy("node", "n", "subs").agg(F.min("doc_id").alias("least"))
    subs = {r["node"]: r["subs"] for r in nodes.collect()}
    table = {}
    for r in minhash.buckets(nodes, 4).collect():
        table.setdefault(r["key"], set()).add(r["node"])
    met = {(a, b) for same in table.values() for a in same for b in same if a < b}
    share = lambda x, y, at: any(x[k] == y[k] for k in at)
    assert met == {(a, b) for a in subs for b in subs if a < b and share(subs[a], subs[b], range(4)) and share(subs[a], subs[b], range(4, 8))}


def test_recall_at_the_threshold():
    """Sets of similarity 0.8 meet in nearly every trial."""
    rnd, missed, trials = np.random.default_rng(1), 0, 1500
    for _ in range(trials):
        a = rnd.integers(0, 1 << 63, 90, dtype=np.uint64)
        both, x, y = a[:80], a[80:90], rnd.integers(0, 1 << 63, 10, dtype=np.uint64)
        with np.errstate(over="ignore"):
            s, t = (minhash.sub_keys(np.concatenate((both, z)), minhash.SIDE, minhash.PART) for z in (x, y))
        same = s == t
        missed += not (same[:minhash.SIDE].any() and same[minhash.SIDE:].any())
    assert missed <= 6  # expected 0.0004 * 1500 = 0.5


@pytest.mark.parametrize("k, want", [(88, False), (89, True), (90, True)])
def test_the_threshold_is_exact(k, want):
    """k of 100 common: 100 k >= 80 (200 - k) from 89 on."""
    assert minhash.similar(np.arange(100, dtype=np.uint64), np.arange(100 - k, 200 - k, dtype=np.uint64)) is want


def test_empty_table(spark):
    docs = docs_frame(spark, [(1, "x")]).where(F.lit(False))
    assert minhash.near_duplicates(docs).count() == 0


def test_query_on_the_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_minhash(spark, sf)) == brute(rows)
