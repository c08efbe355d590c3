import random
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from sojourn.llm import simhash
from sojourn.llm.components import components

from .helpers import docs_frame, odd_rows


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def plain_classes(nodes, links):
    """{node: smallest node reachable}"""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if (root[a], root[b]) != (m, m):
                root[a] = root[b] = m
                changed = True
    return root


def test_fingerprint_by_definition():
    for text in ("", "A b", "The THE the cat\tsat\x0bon\x0cit", "É é Ünï   x y z", "a b c d e f g h i j"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(0)
    values = [rng.getrandbits(64) & 0xFFF for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert set(tree.within(q, 2)) == {v for v in values if (v ^ q).bit_count() <= 2}


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_links_of_near_values(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng = random.Random(1)
    values = {0, -1, -(1 << 63)}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.add(v - (1 << 64) if v >> 63 else v)
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
    mask = (1 << 64) - 1
    pairs = [(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 2]
    got = {r["node"]: r["root"] for r in components(simhash.links_of(spark.createDataFrame([(v,) for v in values], "fp long"), 2)).collect()}
    want = plain_classes(values, pairs)
    assert {v: got.get(v, v) for v in values} == want


@pytest.mark.parametrize("radius,shard_rows", [(2, 8), (2, 200), (1, 8), (3, 8)])
def test_large_shards_lose_no_link(spark, monkeypatch, radius, shard_rows):
    """Fingerprints that all agree on two bands or more: keyed again by a third, and what is still large dealt into parts."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng = random.Random(radius)
    top = rng.getrandbits(36) << 28
    values = {simhash.signed(top | rng.getrandbits(12)) for _ in range(300)} | {simhash.signed(top | rng.getrandbits(28)) for _ in range(200)}
    mask = (1 << 64) - 1
    pairs = [(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= radius]
    links = simhash.links_of(spark.createDataFrame([(v,) for v in values], "fp long"), radius)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = plain_classes(values, pairs)
    assert {v: got.get(v, v) for v in values} == want


def test_third_bands_cover_all_near_pairs():
    """Whatever at most ``radius`` bits differ outside a pair of bands, some mask keeps none of them."""
    for radius in (1, 2, 3):
        for pair, masks in zip(*simhash.band_masks(radius)):
            rest = [k for k in range(64) if not pair >> k & 1]
            assert all(m & pair == pair for m in masks) and sum(m ^ pair for m in masks) == ((1 << 64) - 1) ^ pair
            for bits in combinations(rest, min(radius, 2)):
                assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_keep_one_shuffles_whole_rows_once(spark):
    docs = docs_frame(spark, [(i, f"text number {i % 40} of some words") for i in range(400)])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())[:1] == [0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning(_row" in line for line in plan.splitlines()) == 2  # the rows and the kept keys


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 200: 100}


def test_near_duplicates_odd_rows(spark):
    rows = simhash.near_duplicates(docs_frame(spark, odd_rows())).collect()
    prints = [(i, plain_fingerprint(t or "")) for i, t in odd_rows()]
    fps = {f for _, f in prints}
    root = plain_classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want


def test_keep_one_of_each_class(spark):
    docs = docs_frame(spark, odd_rows())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    got = sorted(str(r["doc_id"]) for r in rows)
    assert got == ["1", "2", "5", "7", "8", "None"]
    assert all(r["_own"] == 9 and r["_id"] == 7 for r in rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []
    assert simhash.keep_one(docs_frame(spark, [])).collect() == []
