"""Operator 5, benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and their white space is made single.
An item of m characters occurs in a text if a stretch of the text is within
k = floor(EDIT_RATE * m) edits of it (fewer where the lemma would say nothing).
By the q-gram lemma such a stretch shares at least m - q + 1 - k * q character
q-grams with the item, and their diagonals (place in the text minus place in the
item) differ by at most k. So shared q-grams are counted in overlapping bands of
2w diagonals (w: a power of two over k); bands that reach the bound are kept and
verified by alignment within the band, all bands of a batch in one matrix: a phrase that many items
share passes the bound of all of them.

The items are the stated query set: they go to the tasks in blocks of
BLOCK_CHARS characters, each block against all texts, without any shuffle.

Edge cases. Null text or item text: empty, matches nothing. An item without a
letter or digit matches nothing. An item shorter than q matches as it is. Null
ids are returned as null. Repeated rows (texts or items): each is matched. Empty
tables: no rows. Extra columns are ignored (``clean`` returns them untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, keyed_text, map_batches
from .text_arrays import code_points

Q = 10
EDIT_RATE = 0.08
#: Characters of items sent to every task at once.
BLOCK_CHARS = 4_000_000
#: Cells of one alignment step, about.
ALIGN_CELLS = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITMAP_BITS = 21


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def gram_codes(cp: np.ndarray, q: int) -> np.ndarray:
    """Polynomial code of the q-gram that starts at each place, by doubling."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    code, done, power, mult = np.zeros(len(cp), dtype=np.uint64), 0, cp.astype(np.uint64), MULTIPLIER
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if q & size:  # append the grams of length `size` behind what is done
                if done == 0:
                    code = power
                else:
                    code = code[:len(power) - done] * mult + power[done:done + len(code)]
                done += size
            if done == q:
                return code[:n]
            power = power[:-size] * mult + power[size:]
            mult = mult * mult
            size *= 2


def align(items: np.ndarray, m: np.ndarray, cp: np.ndarray, start: np.ndarray, n: np.ndarray, lo: np.ndarray, width: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the least edits of an item (``items[row, :m]``) against a stretch of a text
    (``cp[start:start + n]``) on the diagonals [lo, lo + width): (edits, start, end), the earliest
    start on ties. Each cell holds edits and start in one integer."""
    most = int(m.max())
    one = np.int64(1) << 40
    far = one * (most + int(n.max()) + 1)
    n = n[:, None]
    d = lo[:, None] + np.arange(width)
    cell = np.where((d >= 0) & (d <= n), d, far)
    steps = np.arange(width, dtype=np.int64) * one
    src = lo[:, None] + np.arange(width + most)
    inside = (src >= 0) & (src < n)
    padded = np.where(inside, cp[np.where(inside, start[:, None] + src, 0)], np.uint32(0xFFFFFFFF))
    for i in range(1, most + 1):
        new = cell + np.where(padded[:, i - 1:i - 1 + width] == items[:, i - 1:i], 0, one)  # text place i - 1 + d
        new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + one)
        there = (d + i >= 0) & (d + i <= n)
        new = np.where(there, new, far)
        new = np.where(there, np.minimum.accumulate(new - steps, axis=1) + steps, far)
        cell = np.where((i <= m)[:, None], new, cell)
    best = cell.argmin(axis=1)
    value = cell[np.arange(len(cell)), best]
    return value >> 40, value & (one - 1), m + lo + best


class Matcher:
    """Finds items (id, normalised text) in texts."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        self.items = [(k, t, code_points(t)) for k, t in items if any(c.isalnum() for c in t)]
        self.short = [n for n, (_, t, _) in enumerate(self.items) if len(t) < q]
        m = np.array([len(t) for _, t, _ in self.items], dtype=np.int64)
        self.m = m
        self.k = np.maximum(np.minimum(np.floor(rate * m).astype(np.int64), (m - q) // q), 0)
        self.bound = np.maximum(m - q + 1 - self.k * q, 1)
        self.shift = np.array([int(k).bit_length() for k in self.k], dtype=np.int64)  # 2 ** shift > k
        codes = [gram_codes(cp, q) for _, _, cp in self.items]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bitmap[self._slot(self.code)] = True

    @staticmethod
    def _slot(code):
        return (code * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITMAP_BITS)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), the best stretch of each pair; places are
        in the normalised text."""
        best: dict[tuple[int, int], tuple] = {}
        texts = [normalise(t) for t in texts]
        for n in self.short:
            for x, text in enumerate(texts):
                if (at := text.find(self.items[n][1])) >= 0:
                    best[x, n] = (0, at, at + len(self.items[n][1]))
        if not len(self.code) or not texts:
            return [(x, n, s, e, d) for (x, n), (d, s, e) in best.items()]
        gap = self.q
        cp = code_points(("\n" * gap).join(texts))  # no item holds a line feed: grams never span texts
        starts = np.concatenate(([0], np.cumsum([len(t) + gap for t in texts])[:-1]))
        with np.errstate(over="ignore"):
            code = gram_codes(cp, self.q)
            at = np.flatnonzero(self.bitmap[self._slot(code)])
        slot = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        real = self.code[slot] == code[at]
        at, slot = at[real], slot[real]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at, item = np.repeat(at, n), self.item[entry]
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - starts[text] - self.place[entry] + (1 << 20)  # items are far below 2 ** 20 long
        shift = self.shift[item]
        band = diagonal >> shift
        # a band and the one before it: [b w, b w + 2 w)
        key_text, key_item = np.concatenate([text, text]), np.concatenate([item, item])
        key_band = np.concatenate([band, band - 1])
        key_place = np.concatenate([self.place[entry], self.place[entry]])
        order = np.lexsort((key_place, key_band, key_item, key_text))
        t, i, b, place = key_text[order], key_item[order], key_band[order], key_place[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
        fresh = new.copy()  # a gram of the item counts once in a band, however often the text repeats it
        fresh[1:] |= place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        size = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else heads
        heads = heads[size >= self.bound[i[heads]]]
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        for shift in np.unique(self.shift[i[heads]]).tolist():
            same = heads[self.shift[i[heads]] == shift]
            same = same[np.argsort(self.m[i[same]], kind="stable")]  # items of like length together
            width = 2 << shift
            at = 0
            while at < len(same):
                rows = max(1, ALIGN_CELLS // (width + int(self.m[i[same[min(at + 4095, len(same) - 1)]]])))
                some = same[at:at + min(rows, 4096)]
                at += len(some)
                x, n, lo = t[some], i[some], (b[some] << shift) - (1 << 20)
                items = np.full((len(some), int(self.m[n].max())), np.uint32(0xFFFFFFFE))
                for k, one in enumerate(n.tolist()):
                    items[k, :self.m[one]] = self.items[one][2]
                edits, first, last = align(items, self.m[n], cp, starts[x], sizes[x], lo, width)
                good = np.flatnonzero(edits <= self.k[n])
                for pair, found in zip(zip(x[good].tolist(), n[good].tolist()),
                                       zip(edits[good].tolist(), first[good].tolist(), last[good].tolist())):
                    if pair not in best or found < best[pair]:
                        best[pair] = found
        return [(x, n, s, e, d) for (x, n), (d, s, e) in sorted(best.items())]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items (id, normalised text) in blocks of about BLOCK_CHARS characters, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r["item_id"], normalise(r["text"])) for r in items.where(part == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_chars): one row per pair of a
    text and an item that occurs in it, with the best stretch."""
    sc, out = docs.sparkSession.sparkContext, None
    for block in blocks_of(benchmark):
        shared = sc.broadcast(block)  # at most about BLOCK_CHARS characters

        def make(shared=shared):
            matcher = Matcher(shared.value, q, rate)

            def work(batch):
                ids = batch.column(0).to_pylist()
                rows = matcher.find(batch.column(1).to_pylist())
                return {"doc_id": [ids[r[0]] for r in rows], "item_id": [matcher.items[r[1]][0] for r in rows],
                        "start": [r[2] for r in rows], "end": [r[3] for r in rows], "edits": [r[4] for r in rows],
                        "item_chars": [int(matcher.m[r[1]]) for r in rows]}

            return work

        got = map_batches(keyed_text(docs), make, "doc_id long, item_id long, start long, end long, edits int, item_chars int")
        out = got if out is None else out.unionAll(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no item occurs."""
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            matcher = Matcher(shared.value, q, rate)

            def keep(texts):
                hit = {r[0] for r in matcher.find(texts)}
                return [k not in hit for k in range(len(texts))]

            return keep

        docs = filter_rows(docs, make)
    return docs
