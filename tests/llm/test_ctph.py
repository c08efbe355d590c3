import hashlib

import numpy as np
import pytest

from sojourn.llm import ctph

from .helpers import docs_frame, odd_rows


def plain_roll(data):
    """Rolling hash plus one, byte by byte from its definition."""
    out, window, mixed = [], [0] * ctph.WINDOW, 0
    for c in data:
        window = window[1:] + [c]
        mixed = (mixed << 5 ^ c) & 0xFFFFFFFF
        total = sum(window) + sum((k + 1) * x for k, x in enumerate(window))
        out.append((total + mixed + 1) & 0xFFFFFFFF)
    return out


def test_rolling_hash_by_definition():
    data = np.random.default_rng(0).integers(0, 256, 300, dtype=np.uint8).tobytes()
    assert ctph.rolling(data).tolist() == plain_roll(data)


def test_common_subsequence_by_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
        assert ctph.common(a, b) == table[-1, -1]


def test_likeness_follows_the_shared_part():
    rng = np.random.default_rng(2)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    a, b = text(800), text(800)
    fa, fb, fe, fc = ctph.fingerprints([a, b, a[:len(a) // 2] + b[:len(a) // 2], a])
    assert fa == fc and ctph.likeness(fa, fc) == 1
    assert ctph.likeness(fa, fb) == 0 < 0.3 < ctph.likeness(fa, fe) < 0.8
    assert ctph.fingerprints([""]) == ["3::"]
    assert ctph.fingerprints([a, b]) == [ctph.fingerprints([a])[0], ctph.fingerprints([b])[0]]


@pytest.mark.parametrize("joined", ["true", "false"])
def test_edited_texts(spark, joined):
    """In one partition, and in several (their borders, and empty ones)."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
    try:
        check_edited_texts(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_edited_texts(spark):
    source = [*odd_rows(), *((100 + k, f"text number {k} " * k) for k in range(20))]
    got = ctph.with_edits(docs_frame(spark, source).repartition(3)).collect()
    order = sorted(((i, t or "") for i, t in source), key=lambda r: (-r[0] if r[0] is not None else 1 << 63, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        f, g, h = ctph.fingerprints([t, edited, after])
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, ctph.likeness(f, g), ctph.likeness(f, h)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_one_row_and_empty_table(spark):
    (r,) = ctph.with_edits(docs_frame(spark, [(1, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1
    assert ctph.with_edits(docs_frame(spark, [])).collect() == []
