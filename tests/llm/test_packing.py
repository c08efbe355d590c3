import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sojourn.llm import packing
from sojourn.llm.word_ids import WordIds

from .helpers import docs_frame, odd_rows, tokenizer


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_use_every_length_as_often_as_counted(counts):
    got = Counter()
    for packs, lengths in packing.pack_histogram(counts, 64):
        assert packs > 0 and sum(lengths) <= 64
        assert lengths == sorted(lengths, reverse=True)
        for n in lengths:
            got[n] += packs
    assert got == Counter(counts)


def test_word_ids_are_the_librarys():
    tok, own = Tokenizer.from_file(tokenizer()), WordIds(tokenizer())
    texts = ["", " ", "Hello, World!! it's 12.5%\n\tÀé x", "a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ 漢字 é", "x" * 300,
             "foo### bar$$$ (baz) ...", "'s 're don't'"]
    texts += [" ".join(texts), "\n\n", "a.b c'd e.'f (g) .h İi ĲĳŒǆ ſt K", "Ab1 AB1 ab1 Ab! AB!", "\x1c\x1f\u3000z\t.q"]
    for _ in range(2):  # cold and warm memo
        ids, n = own.encode(texts)
        assert len(n) == len(texts)
        for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert part.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode([])[0].tolist() == [] and own.encode([""])[1].tolist() == [0]


def test_random_texts_and_a_small_memo(monkeypatch):
    from sojourn.llm import word_ids

    from .test_token_counts import random_texts

    monkeypatch.setattr(word_ids, "MEMO_PARTS", 30)
    tok, own = Tokenizer.from_file(tokenizer()), word_ids.WordIds(tokenizer())
    texts = random_texts(1500, 11)
    for k in range(0, len(texts), 100):
        ids, n = own.encode(texts[k:k + 100])
        for t, part in zip(texts[k:k + 100], np.split(ids, np.cumsum(n)[:-1])):
            assert part.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, source, max_len):
    tok = Tokenizer.from_file(tokenizer())
    docs = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    assert set(docs) == {i for i, _ in source}
    for i, pieces in docs.items():
        texts = [t or "" for j, t in source if j == i]
        want = Counter()
        for t in texts:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
            for at in range(0, len(ids), max_len):
                part = ids[at:at + max_len]
                want[at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
        assert want == Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces)
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len


def test_pack_odd_rows(spark):
    rows = packing.pack(docs_frame(spark, odd_rows()).repartition(3), tokenizer(), max_len=16).collect()
    check(rows, odd_rows(), 16)


def test_pack_empty_table(spark):
    assert packing.pack(docs_frame(spark, []), tokenizer()).collect() == []
