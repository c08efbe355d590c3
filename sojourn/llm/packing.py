"""Operator 1, packing: shortest-pack-first over the length histogram.

1. One pass tokenizes every text, cuts a document of more than ``max_len`` ids
   into full pieces and a rest, and writes one small row per piece (length and
   CRC of its ids; the ids themselves are never stored or shuffled), with the
   piece's rank among the equal lengths of its task.
2. The histogram (at most ``max_len`` rows) goes to the driver, where
   ``pack_histogram`` places lengths longest first into the emptiest pattern
   ("shortest pack"), keeping counts of patterns, not packs.
3. Ranks of tasks are turned into global ranks by a join with running counts
   per (task, length); each piece finds its slot (pattern, copy, offset) by its
   length and rank, in a table whose size depends on ``max_len`` only.

Edge cases. Null or empty text: the document is the end id alone. Repeated rows:
each is packed as a document of its own. Null id: kept, as null. Empty table:
no rows. Extra columns are ignored. Texts of any length are cut, never dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, map_batches, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, max_len: int) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, task, local_rank)."""

    def make():
        import zlib
        from array import array
        from collections import defaultdict

        from pyspark import TaskContext

        from .word_ids import word_ids

        words, end = word_ids(tokenizer), array("I", [end_id]).tobytes()
        ranks, task = defaultdict(int), TaskContext.get().partitionId()
        step = 4 * max_len

        def work(batch):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local_rank")}
            ids, sizes = words.encode(batch.column(1).to_pylist())
            raw_ids, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                raw = raw_ids[a:b].tobytes() + end
                for at in range(0, len(raw), step):
                    piece = raw[at:at + step]
                    n = len(piece) // 4
                    out["doc_id"].append(doc)
                    out["start"].append(at // 4)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(raw) // 4)
                    out["task"].append(task)
                    out["local_rank"].append(ranks[n])
                    ranks[n] += 1
            return out

        return work

    return map_batches(keyed_text(docs), make, PIECES, max_bytes=1 << 21)  # fewer, larger calls of the library


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: [(how many packs, their lengths)], every length used
    exactly as often as counted. Patterns are kept in a heap by free space."""
    heap: list[tuple[int, int, int, tuple]] = []  # (-free, tie, packs, lengths as a linked list)
    tie = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                free, _, packs, lengths = heapq.heappop(heap)
                if packs > left:
                    heapq.heappush(heap, (free, (tie := tie + 1), packs - left, lengths))
            else:
                free, packs, lengths = -max_len, left, ()
            used = min(packs, left)
            heapq.heappush(heap, (free + length, (tie := tie + 1), used, (lengths, length)))
            left -= used

    def unroll(x):
        out = []
        while x:
            x, length = x
            out.append(length)
        return out[::-1]

    return [(packs, unroll(lengths)) for _, _, packs, lengths in sorted(heap, key=lambda h: h[1])]


def slots_of(patterns: list[tuple[int, list[int]]], max_len: int):
    """Arrays sorted by (length, first rank): key = length, first rank, first
    sequence, offset. Ranks of a length are dealt to its slots in this order."""
    rank = np.zeros(max_len + 1, dtype=np.int64)
    rows, sequence = [], 0
    for packs, lengths in patterns:
        at = 0
        for n in lengths:
            rows.append((n, rank[n], sequence, at))
            rank[n] += packs
            at += n
        sequence += packs
    slots = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return slots[np.lexsort((slots[:, 1], slots[:, 0]))]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, max_len: int = 4096) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer, end_id, max_len), "pieces")

    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("first_rank"))

    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots_of(pack_histogram(histogram, max_len), max_len)
    shared = spark.sparkContext.broadcast(slots)

    def place(batches):
        table = shared.value
        bounds = np.searchsorted(table[:, 0], np.arange(max_len + 2))
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            slot = np.empty(len(pdf), dtype=np.int64)
            for n in np.unique(length):
                lo, hi = bounds[n], bounds[n + 1]
                at = np.flatnonzero(length == n)
                slot[at] = lo + np.searchsorted(table[lo:hi, 1], rank[at], side="right") - 1
            pdf["sequence_id"] = table[slot, 2] + rank - table[slot, 1]
            pdf["offset"] = table[slot, 3]
            yield pdf.drop(columns="rank")

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(starts, ["task", "length"]).select(*cols, (F.col("first_rank") + F.col("local_rank")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long")
