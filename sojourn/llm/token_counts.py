"""Operator 10, token counts by a finite-state tokenizer.

The tokenizer's file is compiled to a deterministic transducer (``transducer``)
whose transitions carry emitted-token counts. A text up to CHUNK code points is
read at once. A longer one is cut into chunks that tasks read apart: each gives
its state map (what the chunk does to the state it starts in, and the tokens it
emits), and maps compose, FAN at a time, in a parallel prefix scan whose number
of rounds is the logarithm of the longest text. A map holds the signs up to the first
place from which on the state is known whatever came before: white space, a border of the
pre-tokenizer, a border that no token reaches over, or a place where all encodings of the
letters before it meet. Only a stretch without any such place (one letter repeated) is kept
as it is until the state before it is known.

Edge cases. Null or empty text: 0 bytes, 0 tokens. Null id: kept. Repeated rows:
each is counted. Special strings inside a text count as one token each, the
library's default. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches, written

#: Code points of a chunk, and maps composed by one task in one round.
CHUNK, FAN = 1 << 16, 64


def cuts_of(text: str, specials: list[str], chunk: int) -> list[int]:
    """Ends of chunks: at least ``chunk`` code points apart, never inside a special
    string nor before a sign that may combine with the one before it."""
    ends, at = [], chunk
    while at < len(text):
        for s in specials:
            k = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= k < at:
                at = k + len(s)
        if at < len(text) and (unicodedata.category(text[at])[0] == "M" or 0x1160 <= ord(text[at]) <= 0x11FF):
            at += 1
            continue
        ends.append(at)
        at += chunk
    return [e for e in ends if e < len(text)] + [len(text)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    texts = keyed_text(docs)
    short = F.length("text") <= chunk

    def make():
        from .transducer import transducer

        t = transducer(tokenizer)

        def work(batch):
            own = batch.column(1).to_pylist()
            return {"doc_id": batch.column(0), "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in own],
                    "n_tokens": [t.count(x) for x in own]}

        return work

    at_once = map_batches(texts.where(short), make, "doc_id long, n_bytes long, n_tokens long")

    def make_cuts():
        from pyspark import TaskContext

        from .transducer import transducer

        specials, row, task = transducer(tokenizer).specials, 0, TaskContext.get().partitionId()

        def work(batch):
            nonlocal row
            out = {k: [] for k in ("doc_id", "row", "k", "text")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for k, end in enumerate(cuts_of(text, specials, chunk)):
                    out["doc_id"].append(doc)
                    out["row"].append(f"{task}-{row}")
                    out["k"].append(k)
                    out["text"].append(text[at:end])
                    at = end
                row += 1
            return out

        return work

    def make_maps():
        from .transducer import transducer

        t = transducer(tokenizer)

        def work(batch):
            own = batch.column(3).to_pylist()
            maps = [t.chunk_map(x) for x in own]
            return {"doc_id": batch.column(0), "row": batch.column(1), "k": batch.column(2),
                    "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in own],
                    "head": [m[0] for m in maps], "how": [m[1] for m in maps], "count": [m[2] for m in maps],
                    "state": [m[3] for m in maps]}

        return work

    schema = "doc_id long, row string, k long, n_bytes long, head string, how int, count long, state string"
    chunks = map_batches(texts.where(~short), make_cuts, "doc_id long, row string, k long, text string")
    maps = written(map_batches(chunks.repartition("row", "k"), make_maps, schema), "maps")

    def compose(pdf):
        from .transducer import transducer

        t, whole = transducer(tokenizer), None
        pdf = pdf.sort_values("k")
        for m in zip(pdf["head"], pdf["how"].astype(int), pdf["count"].astype(int), pdf["state"]):
            whole = m if whole is None else t.compose(whole, m)
        out = pdf.iloc[:1].copy()
        out["k"] = out["k"] // FAN
        out["n_bytes"] = pdf["n_bytes"].sum()
        out["head"], out["how"], out["count"], out["state"] = whole
        return out

    last = maps.agg(F.max("k")).first()[0] or 0
    while last > 0:  # logarithm of the longest text, to the base FAN
        maps = maps.groupBy("row", F.floor(F.col("k") / FAN).alias("group")).applyInPandas(compose, schema)
        last //= FAN
        if last > 0:
            maps = written(maps, "maps")

    def make_ends():
        from .transducer import transducer

        t = transducer(tokenizer)

        def work(batch):
            rows = [batch.column(k).to_pylist() for k in range(4, 8)]
            return {"doc_id": batch.column(0), "n_bytes": batch.column(3), "n_tokens": [t.finish(m) for m in zip(*rows)]}

        return work

    composed = map_batches(maps.withColumnRenamed("head", "text").select(
        "doc_id", "row", "k", "n_bytes", "text", "how", "count", "state"), make_ends, "doc_id long, n_bytes long, n_tokens long")
    return at_once.unionAll(composed).withColumn("over_limit", F.col("n_tokens") > limit)
