"""Small frames for the operators of ``sojourn.llm``."""

TOKENIZER = "word_bpe_49k.json"

#: Extra columns under names that operators use inside.
CLASHES = "key long, block int, fp long, th long, rank long, task long, word string, _id long, _hash long, _own long, score double"


def docs_frame(spark, rows, lang="en", source="s"):
    """(doc_id, text) pairs as a documents table with extra columns."""
    full = [(i, t, lang, source, None if t is None else len(t), 1, 2, 3, 4, 5, 6, "w", 7, 8, 9, 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)


def odd_rows():
    """Nulls, empty, white space, ties, repeated rows, one word, a long text."""
    long = " ".join(f"Word{k % 97} other{k % 31}," for k in range(9000))
    return [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (3, ""), (4, " \t\n "), (None, "no id here at all"),
            (None, None), (5, "x"), (6, "the cat sat on the mat"), (7, long), (8, "ünï cödé 漢字 🙂 <|endoftext|> it's")]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)
