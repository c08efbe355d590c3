import random

import pytest

from sojourn.llm import decontam as d

from .helpers import docs_frame, odd_rows


def least_edits(item, text):
    """Sellers' algorithm: least edits of item against any stretch of text."""
    prev = list(range(len(item) + 1))
    best = prev[-1]
    for c in text:
        cur = [0]
        for i in range(1, len(item) + 1):
            cur.append(min(prev[i - 1] + (item[i - 1] != c), prev[i] + 1, cur[i - 1] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def test_found_exactly_where_edits_allow():
    rng, found = random.Random(4), 0
    for _ in range(150):
        item = d.normalise("".join(rng.choice("abcdefghij ") for _ in range(rng.randint(3, 90))))
        if not item:
            continue
        changed = list(item)
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(changed) + 1)
            changed[k:k + rng.randint(0, 1)] = rng.choice(["", "z"])
        noise = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 250)))
        text = noise[:90] + "".join(changed) + noise[90:]
        m = d.Matcher([(1, item)])
        got, least = m.find(["zzz", text, ""]), least_edits(item, d.normalise(text))
        if least <= m.k[0]:
            found += 1
            (x, _, start, end, edits), = got
            assert x == 1 and edits == least
            assert least_edits(d.normalise(text)[start:end], item) <= edits
        else:
            assert got == []
    assert found > 40


def test_gram_codes_tell_grams_apart():
    from sojourn.llm.text_arrays import code_points

    for q in (1, 2, 3, 5, 10):
        text = "abcabcabcdabcdéabca"
        code = d.gram_codes(code_points(text), q)
        grams = [text[k:k + q] for k in range(len(text) - q + 1)]
        assert len(code) == len(grams)
        assert len(set(code.tolist())) == len(set(grams)) and len(set(zip(code.tolist(), grams))) == len(set(grams))


ITEM = "What is the capital of the largest country on that continent?"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_contaminated_rows(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_CHARS", block)
    texts = [*odd_rows(), (20, f"before {ITEM.upper()} after"), (21, ITEM.replace("largest", "lergest").replace(" ", "\n ")),
             (22, ITEM[:30]), (None, ITEM)]
    items = bench(spark, [(1, ITEM), (2, None), (3, ""), (4, "???"), (5, "漢字"), (None, "no id here at all"), (6, ITEM)])
    rows = d.contaminated(docs_frame(spark, texts), items).collect()
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in rows)
    assert got == sorted([("20", "1", 0), ("20", "6", 0), ("21", "1", 1), ("21", "6", 1), ("None", "1", 0), ("None", "6", 0),
                          ("8", "5", 0), ("None", "None", 0)])
    docs = docs_frame(spark, texts)
    clean = d.clean(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(["1", "1", "2", "3", "4", "None", "5", "6", "7", "22"])


def test_empty_tables(spark):
    assert d.contaminated(docs_frame(spark, []), bench(spark, [(1, ITEM)])).collect() == []
    assert d.contaminated(docs_frame(spark, odd_rows()), bench(spark, [])).collect() == []
    assert d.clean(docs_frame(spark, odd_rows()), bench(spark, [])).count() == len(odd_rows())


def test_a_phrase_that_all_items_share_takes_seconds():
    """Templated items pass every count; only those that occur are found."""
    import time

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    head = "which of the following sentences is true here"
    items = [(k, f"{head} {word(9)} {word(8)} {word(9)} {word(8)}") for k in range(4000)]
    texts = [f"{word(30)} {head} {word(12)} {word(20)} {word(30)}" for _ in range(99)] + [f"xx {items[77][1][:-3]} yy"]
    m = d.Matcher([(k, d.normalise(t)) for k, t in items])
    begun = time.time()
    assert [(r[0], m.items[r[1]][0], r[4]) for r in m.find(texts)] == [(99, 77, least_edits(items[77][1], texts[-1]))]
    assert time.time() - begun < 60
