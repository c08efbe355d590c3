"""Periodic runs against every lag of every text, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.llm import periodic, queries

from .helpers import docs_frame, odd_rows


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def brute_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def a_text(rnd):
    """Words of a small alphabet in one of six shapes, some of them hard for windows."""
    n, k = rnd.randrange(0, 400), rnd.choice([1, 2, 2, 3, 5, 50])
    w = [rnd.randrange(k) for _ in range(n)]
    kind = rnd.randrange(6)
    if kind == 1 and n:
        a = rnd.randrange(n)
        p = 1 + (n - a) // (3 + rnd.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    elif kind == 2:
        u, v = ([rnd.randrange(k) for _ in range(rnd.randrange(1, 60))] for _ in range(2))
        w = []
        while len(w) < n:
            w += rnd.choice([u, v, u + u, [rnd.randrange(k)]])
    elif kind == 3:  # Fibonacci word
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    elif kind == 4:  # Thue-Morse word: prefix hashes modulo 2^64 collide on it
        w = [bin(i).count("1") % 2 for i in range(4 * n)]
    elif kind == 5:  # touching runs of one short period
        u = [rnd.randrange(2) for _ in range(rnd.randrange(1, 4))]
        half = (u * 200)[:rnd.randrange(1, 120)]
        w = half * rnd.choice([2, 2, 3]) + [9] * rnd.randrange(0, 3) + half
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_batches_equal_every_lag_of_every_text(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        texts = [a_text(rnd) for _ in range(rnd.randrange(1, 6))]
        got = periodic.runs_of(np.array([len(t) for t in texts]), np.array([w for t in texts for w in t], dtype=np.int64))
        want, begin = [], 0
        for t in texts:
            want += [[s + begin, s + begin + length, q] for s, length, q in brute_runs(t)]
            begin += len(t)
        assert got.tolist() == want


def test_long_words_of_equal_hash_are_told_apart():
    x = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], dtype=np.int64)
    for s, e, q in periodic.runs_of(np.array([len(x)]), x).tolist():
        assert (x[s:e - q] == x[s + q:e]).all() and e - s >= 2 * q


def test_query_equals_brute_force_on_the_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == {brute_row(r["doc_id"], r["text"]) for r in rows}


def test_odd_rows(spark):
    rows = odd_rows() + [(10, "a " * 30), (26, "x y z " * 50 + "tail"), (26, "x y z " * 50 + "tail")]
    got = periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(docs_frame(spark, rows)))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(*r)) for r in rows)


def test_real_outputs(spark):
    docs = docs_frame(spark, [(1, "start " + "one two three " * 5 + "end")])
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] and row["collapsed"] == "start one two three end"


def test_empty_table(spark):
    docs = docs_frame(spark, [(1, "x")]).where(F.lit(False))
    assert periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(docs))).count() == 0


def test_a_run_is_found_at_every_batch_size(spark):
    text = " ".join(f"w{k % 1000}" for k in range(70000))
    row = periodic.digests(periodic.periodic_runs(docs_frame(spark, [(k, text) for k in range(3)]))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 0, 70000, 1000, 70000)
