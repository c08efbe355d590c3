import random

import pytest
from tokenizers import Tokenizer

from sojourn.llm import token_counts
from sojourn.llm.transducer import transducer

from .helpers import docs_frame, odd_rows, tokenizer

PIECES = ["'s", "'re", "'", "''", "it's", "I'LL", "x'r", "x'v'l", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "  ", "\n", "\x1c",
          " ", "　", "é", "é", "İ", "Σ", "ß", "漢字", "한국", "١٢", "½", "123", "4.5", "...", "—", "🙂", "hello", "World",
          "antidisestablishmentarianism", "aaaaaaaa", "\u0000", "́", "$%^", "the", "ing", "thnted"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) if rng.random() < 0.8 else chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF))))
                    for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_transducer_counts_as_the_library(library):
    t = transducer(tokenizer())
    for text in random_texts(4000, 1):
        assert t.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_chunk_maps_compose_in_any_grouping(library):
    t, rng = transducer(tokenizer()), random.Random(2)
    for text in random_texts(1500, 3):
        ends = token_counts.cuts_of(text, t.specials, rng.randint(1, 6)) if text else [0]
        maps = [t.chunk_map(text[a:b]) for a, b in zip([0, *ends], ends)]
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k:k + 2] = [t.compose(maps[k], maps[k + 1])]
        assert t.finish(maps[0]) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def long_stretches(n):
    rng = random.Random(7)
    yield "cjk", "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    yield "kana", "".join(chr(rng.randrange(0x3041, 0x3096)) for _ in range(n))
    yield "greek", "".join(chr(rng.randrange(0x3B1, 0x3C9)) for _ in range(n))
    yield "base64", "".join(rng.choice("ABCDEFGHIJabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    yield "letters", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    yield "dna", "".join(rng.choice("acgt") for _ in range(n))
    yield "prose", "".join(rng.choice(["the", "ing", "and", "ation", "co", "er", "x"]) for _ in range(n // 3))
    yield "signs", "".join(rng.choice("!?.,-=*#'\"~") for _ in range(n))


@pytest.mark.parametrize("chunk", [1000, 3001])
def test_maps_without_white_space_are_bounded(library, chunk):
    t, rng = transducer(tokenizer()), random.Random(8)
    for name, text in long_stretches(12_000):
        ends = token_counts.cuts_of(text, t.specials, chunk)
        maps = [t.chunk_map(text[a:b]) for a, b in zip([0, *ends], ends)]
        assert max(len(m[0]) for m in maps if m[1]) <= 600, name
        assert all(m[1] for m in maps[:-1]), name
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k:k + 2] = [t.compose(maps[k], maps[k + 1])]
        assert len(maps[0][0]) <= 600, name
        assert t.finish(maps[0]) == len(library.encode(text, add_special_tokens=False).ids), name


def test_million_signs_without_white_space(library):
    t, rng = transducer(tokenizer()), random.Random(9)
    text = "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(1_000_000))
    ends = token_counts.cuts_of(text, t.specials, token_counts.CHUNK)
    maps = [t.chunk_map(text[a:b]) for a, b in zip([0, *ends], ends)]
    assert max(len(m[0]) for m in maps) <= 600
    whole = maps[0]
    for m in maps[1:]:
        whole = t.compose(whole, m)
    assert t.finish(whole) == len(library.encode(text, add_special_tokens=False).ids)


def test_one_letter_repeated(library):
    t = transducer(tokenizer())
    for text in ("a" * 5000, "'" * 3000, "ab" * 2500, "'s" * 2000, "'r" * 2000, "é" * 2000):
        ends = token_counts.cuts_of(text, t.specials, 700)
        whole = ("", 0, 0, "")
        for a, b in zip([0, *ends], ends):
            whole = t.compose(whole, t.chunk_map(text[a:b]))
        assert t.finish(whole) == len(library.encode(text, add_special_tokens=False).ids), text[:2]


def test_bounded_tables_do_not_change_counts(library, monkeypatch):
    from sojourn.llm import transducer as module

    monkeypatch.setattr(module, "MAX_STATES", 40)
    monkeypatch.setattr(module, "MAX_WORDS", 5)
    t = module.Transducer(tokenizer())
    for text in random_texts(300, 5):
        assert t.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert t.finish(t.chunk_map(text)) == t.count(text)


@pytest.mark.parametrize("chunk", [1 << 16, 500])
def test_count_odd_rows(spark, library, chunk):
    rows = token_counts.count_tokens(docs_frame(spark, odd_rows()), tokenizer(), limit=5, chunk=chunk).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in rows)


def test_count_empty_table(spark):
    assert token_counts.count_tokens(docs_frame(spark, []), tokenizer()).collect() == []
