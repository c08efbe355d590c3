"""Operator 6, language-model scoring by masked pseudo-likelihood.

A bidirectional window network (numpy) predicts every token from the WINDOW tokens
on either side of it, never from itself: P(token) = P(class | window) x P(leaf | class, window)
x P(word | leaf). For the class, hidden = tanh(sum of one embedding table per offset), then a
softmax over the classes. A document's score is the sum of the log-probabilities of its tokens.

Tokens are white-space words in lower case. The WORDS most frequent words of the whole
corpus (counted per task, then summed) are classes of their own; any other word falls
in a bucket by its shape and ending. Below each bucket stands a binary tree over bits
of the words' hashes (a hierarchical softmax): at a node, the log-odds are those of the
whole corpus's tokens below it plus hidden x the node's weights, so the window tells words
of a bucket apart. Its depth grows with the corpus's distinct words (LEAF to a leaf, at
most MAX_DEPTH). In a leaf a word has its share of the leaf's tokens in the whole corpus.
So the vocabulary is every word of the corpus; with untrained trees P(word | class) is the
word's share of its bucket.

Words outside the classes are counted by their 64-bit hash: texts are gathered in blocks of
about BLOCK such tokens, each with a dictionary of its words; the dictionaries are cut
into shards by hash, summed over the blocks of a shard, and the sums joined back to
the blocks. What is shuffled grows with the distinct words of the blocks, and a word
that every text has is one entry a block.

All texts are written once as ids, one byte a token, and the bits of the hashes, another byte. Training goes over all of them in
ROUNDS rounds: every task starts from
the shared weights, learns the masked positions of its rows (a share of 1 / MASK,
drawn by a hash) by Adam, and returns its weights; their mean, weighted by positions
learned, starts the next round. Weights are summed in two steps, so no task gathers
those of all tasks.

Edge cases. Null or empty text, or white space only: no tokens, log-probability 0,
mean null. Null id: kept. Repeated rows: each is scored. Empty table: no rows
(and untrained weights). Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .common import arrow_schema, keyed_text, map_batches, small_batches, written
from .text_arrays import code_points, letters, run_hashes, sums

#: Words that are classes of their own; shapes and ending buckets of other words; id 0 is the border.
WORDS, SHAPES, ENDINGS = 191, 4, 16
VOCABULARY = 1 + WORDS + SHAPES * ENDINGS
BUCKETS = SHAPES * ENDINGS
#: Distinct words to a leaf of a bucket's tree, on average; bits that a leaf has at most (a byte holds 8).
LEAF, MAX_DEPTH = 64, 7
WINDOW, HIDDEN, MASK, ROUNDS = 2, 16, 16, 3
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
#: Positions handled at once; distinct words a task holds before it passes its counts on.
STEP, MAX_COUNTS = 4096, 200_000
#: Parts that the weight vector is cut into for summing, and groups of the first step.
PARTS, GROUPS = 8, 32
#: Tokens outside the classes in a block of texts; entries of block dictionaries in a shard.
BLOCK, SHARD = 1 << 19, 1 << 18


PUNCTUATION = ".,;:!?"


@lru_cache(maxsize=1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether str.split() cuts there; and 1 for a letter, 2^20 for
    another letter or digit, 2^40 for PUNCTUATION, so that one sum counts all three."""
    space = np.fromiter((chr(c).isspace() for c in range(0x110000)), dtype=bool, count=0x110000)
    kind = letters().astype(np.int64)
    digit = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000) & ~letters()
    kind[digit] = 1 << 20
    kind[[ord(c) for c in PUNCTUATION]] = 1 << 40
    return space, kind


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, count): of every white-space word, in lower case, its 64-bit hash and
    its bucket by shape and ending; and the number of words of each text."""
    lowered = [t.lower() for t in texts]
    cp = code_points("".join(t + " " for t in lowered))
    space, kind = kinds()
    gap = space[cp]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # starts and ends of words, in turn
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(lowered)))
    n = np.diff(np.searchsorted(start, ends), prepend=0)
    h = run_hashes(cp, start, end)
    counts = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind[cp])))
    counts = counts[end] - counts[start]
    letter, digit, mark, length = counts & 0xFFFFF, counts >> 20 & 0xFFFFF, counts >> 40, end - start
    shape = np.where(letter + digit == 0, 1, np.where(letter + digit + mark != length, 3, np.where(digit > 0, 2, 0)))
    last, second = cp[end - 1].astype(np.int64), cp[np.maximum(end - 2, start)].astype(np.int64)
    return h, shape * ENDINGS + (last + 5 * second) % ENDINGS, n


class Words:
    """Ids of words: 1 + place among the frequent ones, else by bucket."""

    def __init__(self, frequent: list[str]):
        h = words_in(frequent)[0]
        order = np.argsort(h)
        self.hash, self.id = h[order], order + 1

    def ids(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        other = 1 + WORDS + bucket
        if not len(self.hash):
            return other
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.id[at], other)


BORDER = bytes(WINDOW)


def encode(texts: list[str], words: Words) -> list[bytes]:
    """The ids of each text's words, one byte each (the vocabulary has 256 ids)."""
    h, bucket, n = words_in(texts)
    raw = words.ids(h, bucket).astype(np.uint8).tobytes()
    ends = np.cumsum(n).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def depth_of(distinct: int) -> int:
    """Depth of the buckets' trees for this many distinct words."""
    return min(MAX_DEPTH, max(0, (distinct // (BUCKETS * LEAF)).bit_length() - 1))


def codes_of(h: np.ndarray, depth: int) -> np.ndarray:
    """``depth`` bits of each word's hash, mixed (words that differ in one letter share their first bits): a leaf."""
    with np.errstate(over="ignore"):
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - depth) if depth else np.zeros(len(h))).astype(np.uint8)


class Trees:
    """One tree of ``depth`` levels below each bucket; node k of bucket b is row b * 2^depth + k
    (the root is 1, the children of k are 2k and 2k + 1). ``totals``: tokens in each leaf of each bucket."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray):
        self.leaves = len(totals) // BUCKETS
        self.depth = self.leaves.bit_length() - 1
        self.weights = weights.reshape(-1, HIDDEN)
        below = np.zeros((BUCKETS, 2 * self.leaves))
        below[:, self.leaves:] = totals.reshape(BUCKETS, self.leaves)
        for k in range(self.leaves - 1, 0, -1):
            below[:, k] = below[:, 2 * k] + below[:, 2 * k + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(below[:, 1::2]) - np.log(below[:, ::2])  # of every pair of children; none: nan
        self.odds = np.clip(np.nan_to_num(odds, nan=0.0, posinf=30, neginf=-30), -30, 30).astype(np.float32).ravel()

    def paths(self, ids: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the places hold a word of a bucket; the nodes on the way to its leaf;
        whether the way goes to the right there)."""
        which = np.flatnonzero(ids[at] > WORDS)
        here = at[which]
        code, level = codes[here].astype(np.int32)[:, None], np.arange(self.depth, dtype=np.int32)
        rows = (ids[here].astype(np.int32)[:, None] - 1 - WORDS) * self.leaves + (1 << level) + (code >> (self.depth - level))
        return which, rows, code >> (self.depth - 1 - level) & 1

    def logits(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.matmul(self.weights[rows], h[:, :, None])[:, :, 0] + self.odds[rows]

    def log_probs(self, h: np.ndarray, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Log-probability of each way, given the hidden values."""
        z = self.logits(h, rows)
        z = np.where(right, -z, z)
        return -(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))).sum(1)


BLOCKS = ("doc_id long, tokens binary, codes binary, block long, place int, "  # a text
          "ends binary, at binary, hashes binary, counts binary, leaves binary, totals array<long>")  # a block


def block_rows(batches, words: Words, schema, depth: int = 0):
    """Record batches of ``schema`` (BLOCKS): a row for every text, and one for every block of texts:
    ``ends`` of its texts among its tokens outside the classes, the place ``at`` of each of
    those in the dictionary ``hashes`` (rising), ``counts`` and ``leaves`` (bucket * 2^depth + code)
    of the dictionary's words, and ``totals`` of all leaves."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    hashes, leaves, per_text = [], [], []

    def close():
        h = np.concatenate(hashes)
        distinct, first, at, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        own = np.concatenate(leaves)
        yield pa.RecordBatch.from_pylist([{
            "block": block, "ends": np.cumsum(np.concatenate(per_text)).astype(np.int64).tobytes(),
            "at": at.astype(np.uint32).tobytes(), "hashes": distinct.tobytes(), "counts": counts.astype(np.int64).tobytes(),
            "leaves": own[first].tobytes(), "totals": np.bincount(own, minlength=BUCKETS << depth).tolist()}], schema=schema)

    place = 0
    for batch in small_batches(batches):
        h, bucket, n = words_in(batch.column(1).to_pylist())
        ids = words.ids(h, bucket).astype(np.uint8)
        rare, ends, rows = ids > WORDS, np.cumsum(n), len(n)
        code = np.where(rare, codes_of(h, depth), 0).astype(np.uint8)
        of_texts = [[raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())] for raw in (ids.tobytes(), code.tobytes())]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), *(pa.array(x, pa.binary()) for x in of_texts),
            pa.array([block] * rows, pa.int64()), pa.array(range(place, place + rows), pa.int32()),
            *(pa.nulls(rows, f.type) for f in list(schema)[5:])], schema=schema)
        place += rows
        hashes.append(h[rare])
        leaves.append(((bucket[rare] << depth) + code[rare]).astype(np.uint16))
        per_text.append(sums(rare.astype(np.int64), ends))
        if sum(map(len, hashes)) >= BLOCK:
            yield from close()
            block, place = block + 1, 0
            hashes, leaves, per_text = [], [], []
    if place:
        yield from close()


def bordered(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each text between WINDOW borders; tokens per text)."""
    ids = np.frombuffer(BORDER + BORDER.join(tokens) + BORDER, dtype=np.uint8)
    return ids, np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))


def places(n: np.ndarray) -> np.ndarray:
    """Place of every token in the array of ``bordered``."""
    return np.arange(n.sum()) + np.repeat(WINDOW * np.arange(1, len(n) + 1), n)


SHAPES_OF = {"e": (len(OFFSETS), VOCABULARY, HIDDEN), "b": (HIDDEN,), "w": (HIDDEN, VOCABULARY), "c": (VOCABULARY,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES_OF.values())


def unpack(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES_OF.items():
        size = int(np.prod(shape))
        out[k] = vector[at:at + size].reshape(shape)  # views: changes reach the vector
        at += size
    return out


def fresh() -> np.ndarray:
    vector = np.zeros(SIZE, dtype=np.float32)
    rng, p = np.random.default_rng(0), unpack(vector)
    p["e"][:] = rng.normal(0, 0.3, p["e"].shape)
    p["w"][:] = rng.normal(0, 0.3, p["w"].shape)
    return vector


def hidden(p: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = p["b"] + p["e"][0][ids[at + OFFSETS[0]]]
    for k, o in enumerate(OFFSETS[1:], 1):
        x += p["e"][k][ids[at + o]]
    return np.tanh(x, out=x)


def log_probs(p: dict, ids: np.ndarray, at: np.ndarray, trees: Trees | None = None, codes: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of the class (with trees: of the leaf) of the token at each place, given both sides."""
    out = np.empty(len(at))
    bounded = (np.abs(p["w"]).sum(0) + np.abs(p["c"])).max() <= 60  # hidden values lie in [-1, 1]
    for s in range(0, len(at), STEP):
        here = at[s:s + STEP]
        h = hidden(p, ids, here)
        logit = h @ p["w"]
        logit += p["c"]
        true = logit[np.arange(len(here)), ids[here]]
        if not bounded:
            np.clip(logit, -60, 60, out=logit)
        out[s:s + STEP] = np.clip(true, -60, 60) - np.log(np.exp(logit, out=logit).sum(1))
        if trees is not None and trees.depth:
            which, rows, right = trees.paths(ids, codes, here)
            out[s + which] += trees.log_probs(h[which], rows, right)
    return out


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each); much faster than np.add.at."""
    order = np.argsort(rows)
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Learner:
    """Adam on masked positions, from given weights; the trees' nodes, of which a batch meets few, by Adagrad."""

    def __init__(self, vector: np.ndarray, totals: np.ndarray | None = None):
        self.x, self.m, self.v, self.steps = vector[:SIZE].copy(), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0
        self.trees = None if totals is None or len(totals) == BUCKETS else Trees(totals, vector[SIZE:].copy())
        self.met = np.full(0 if self.trees is None else len(self.trees.weights), 1e-7, np.float32)

    def weights(self) -> np.ndarray:
        return self.x if self.trees is None else np.concatenate((self.x, self.trees.weights.ravel()))

    def learn(self, ids: np.ndarray, at: np.ndarray, codes: np.ndarray | None = None, rate: float = 0.05, batch: int = 512) -> None:
        p = unpack(self.x)
        for s in range(0, len(at), batch):
            here = at[s:s + batch]
            n, rows = len(here), np.arange(len(here))
            h = hidden(p, ids, here)
            q = h @ p["w"] + p["c"]
            q = np.exp(q - q.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[rows, ids[here]] -= 1
            q /= n
            g = np.zeros(SIZE, dtype=np.float32)
            d = unpack(g)
            d["w"][:], d["c"][:] = h.T @ q, q.sum(0)
            back = q @ p["w"].T
            if self.trees is not None:
                self.learn_trees(ids, here, codes, h, back)
            back *= 1 - h * h
            d["b"][:] = back.sum(0)
            for k, o in enumerate(OFFSETS):
                met, g_met = summed(ids[here + o].astype(np.int32), back)
                d["e"][k][met] = g_met
            self.steps += 1
            self.m += 0.1 * (g - self.m)
            self.v += 0.01 * (g * g - self.v)
            k = self.steps
            self.x -= rate * (self.m / (1 - 0.9 ** k)) / (np.sqrt(self.v / (1 - 0.99 ** k)) + 1e-7)

    def learn_trees(self, ids: np.ndarray, here: np.ndarray, codes: np.ndarray, h: np.ndarray, back: np.ndarray,
                    rate: float = 0.2) -> None:
        """One step of the nodes that a batch meets; adds their part of the hidden values' gradient to ``back``."""
        which, rows, right = self.trees.paths(ids, codes, here)
        if not len(which):
            return
        own = h[which]
        off = (1 / (1 + np.exp(-np.clip(self.trees.logits(own, rows), -60, 60))) - right).astype(np.float32)
        back[which] += np.matmul(off[:, None, :], self.trees.weights[rows])[:, 0] / len(here)
        nodes, g = summed(rows.ravel(), (off[:, :, None] * own[:, None, :]).reshape(-1, HIDDEN))
        self.met[nodes] += (g * g).sum(1)
        self.trees.weights[nodes] -= rate * g / np.sqrt(self.met[nodes])[:, None]


def masked(tokens: list[bytes], n: np.ndarray, turn: int) -> np.ndarray:
    """Which of all tokens of these texts are masked in this round: by a hash of the
    text's ids, the token's place and the round."""
    seeds = np.array([zlib.crc32(t) * ROUNDS + turn for t in tokens], dtype=np.uint64)
    place = np.arange(n.sum(), dtype=np.uint64) - np.repeat((np.cumsum(n) - n).astype(np.uint64), n)
    with np.errstate(over="ignore"):
        h = np.repeat(seeds, n) * np.uint64(0xD1B54A32D192ED03) + place * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero(h >> np.uint64(32) < np.uint64((1 << 32) // MASK))


def vocabulary(texts: DataFrame) -> list[str]:
    """The WORDS most frequent words of all texts (ties: the smaller word)."""
    return counted_words(texts)[0]


def counted_words(texts: DataFrame) -> tuple[list[str], int]:
    """(the WORDS most frequent words of all texts, number of distinct words), by one job."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401
        from collections import Counter

        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())],
                                                  names=["word", "n"])
        for batch in small_batches(batches):
            for t in batch.column(1).to_pylist():
                seen.update(t.lower().split())
                if len(seen) > MAX_COUNTS:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = Observation()
    top = counts.observe(seen, F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"), "word").limit(WORDS).collect()  # at most WORDS rows
    return [r["word"] for r in top], seen.get.get("words") or 0


def train_round(encoded: DataFrame, vector: np.ndarray, turn: int, totals: np.ndarray | None = None) -> np.ndarray:
    """Weights after one round over all encoded texts."""
    shared = encoded.sparkSession.sparkContext.broadcast((vector, totals))  # SIZE numbers, and at most HIDDEN + 1 a leaf
    cuts = np.linspace(0, len(vector), PARTS + 1).astype(int)

    def learn(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        learner, learned = Learner(*shared.value), 0
        for batch in small_batches(batches, "tokens"):
            tokens = batch.column(1).to_pylist()
            ids, n = bordered(tokens)
            codes = bordered(batch.column(2).to_pylist())[0] if learner.trees else None
            at = places(n)[masked(tokens, n, turn)]
            at = np.random.default_rng(len(at)).permutation(at)
            learner.learn(ids, at, codes)
            learned += len(at)
        if learned:
            task, x = TaskContext.get().partitionId(), learner.weights()
            yield pa.RecordBatch.from_arrays([
                pa.array([task] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()),
                pa.array([float(learned)] * PARTS, pa.float64()),
                pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ], names=["task", "part", "n", "weights"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        n = pdf["n"].sum()
        total = sum(np.frombuffer(w, dtype=np.float32) * (k / n) for w, k in zip(pdf["weights"], pdf["n"]))
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [n],
                             "weights": [total.astype(np.float32).tobytes()]})

    schema = "task long, part int, n double, weights binary"
    rows = encoded.mapInArrow(learn, schema)
    rows = rows.groupBy("part", F.pmod("task", F.lit(GROUPS)).alias("g")).applyInPandas(mean, schema)
    rows = rows.groupBy("part").applyInPandas(mean, schema)
    parts = sorted(rows.collect(), key=lambda r: r["part"])  # PARTS rows, as many numbers as ``vector``
    if not parts:
        return vector
    return np.concatenate([np.frombuffer(bytes(r["weights"]), dtype=np.float32) for r in parts])


def encoded_blocks(texts: DataFrame) -> tuple[list[str], DataFrame]:
    """(words that are classes of their own, BLOCKS): all texts as ids and the dictionaries
    of their blocks, written once for the rounds and the scores."""
    frequent, distinct = counted_words(texts)
    depth, schema = depth_of(distinct), arrow_schema(_parse_datatype_string(BLOCKS))
    rows = texts.mapInArrow(lambda batches: block_rows(batches, Words(frequent), schema, depth), BLOCKS)
    return frequent, written(rows, "tokens")


def encoded_texts(texts: DataFrame) -> tuple[list[str], DataFrame]:
    """(words that are classes of their own, (doc_id, tokens, codes))."""
    frequent, blocks = encoded_blocks(texts)
    return frequent, blocks.where("tokens is not null").select("doc_id", "tokens", "codes")


def leaf_totals(blocks: DataFrame) -> tuple[np.ndarray, int]:
    """(tokens in each leaf of each bucket, entries of all blocks' dictionaries)."""
    own = blocks.where("hashes is not null")
    sizes = own.select(F.length("hashes").alias("bytes"), F.posexplode("totals").alias("leaf", "n"))
    sizes = sizes.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()  # a row for every leaf
    totals = np.zeros(max(BUCKETS, len(sizes)), dtype=np.int64)
    for r in sizes:
        totals[r["leaf"]] = r["n"]
    return totals, max((r["bytes"] for r in sizes), default=0) // 8


def within_classes(blocks: DataFrame, sizes: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(block, place, within): for every text the sum of log P(word | leaf) over its tokens;
    a word that is a class of its own adds 0. ``sizes``: the blocks' ``leaf_totals``."""
    own = blocks.where("hashes is not null")
    totals, entries = sizes or leaf_totals(blocks)
    total = np.maximum(totals, 1)
    bits = max(1, (entries // SHARD).bit_length())
    # What is shuffled takes 24 bytes an entry; partitions of at most about 64 MB, however large the corpus.
    parts = entries * 24 >> 26
    few = parts <= int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, key: df if few else df.repartition(parts, key)

    def cut(batches):
        import pyarrow as pa

        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for block, h, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ends = np.searchsorted(np.frombuffer(h, dtype=np.uint64), edges).tolist()
                parts = [(s, a, b) for s, (a, b) in enumerate(zip([0, *ends], [*ends, len(h) // 8])) if b > a]
                if parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block] * len(parts), pa.int64()), pa.array([s for s, _, _ in parts], pa.int64()),
                        *(pa.array([x[8 * a:8 * b] for _, a, b in parts], pa.binary()) for x in (h, n))],
                        names=["block", "shard", "hashes", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = (np.frombuffer(b"".join(pdf[k]), dtype=t) for k, t in (("hashes", np.uint64), ("counts", np.int64)))
        distinct, at = np.unique(h, return_inverse=True)
        raw = np.bincount(at, weights=n, minlength=len(distinct))[at].tobytes()  # whole numbers, exact below 2^53
        ends = np.cumsum([len(x) for x in pdf["hashes"]]).tolist()
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "n": [raw[a:b] for a, b in zip([0, *ends], ends)]})

    def sum_up(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        n = np.frombuffer(b"".join(counted.sort_values("shard")["n"]), dtype=np.float64)
        log = np.log(n / total[np.frombuffer(r["leaves"], dtype=np.uint16)])
        within = sums(log[np.frombuffer(r["at"], dtype=np.uint32)], np.frombuffer(r["ends"], dtype=np.int64))
        return pd.DataFrame({"block": r["block"], "place": np.arange(len(within), dtype=np.int32), "within": within})

    shards = own.select("block", "hashes", "counts").mapInArrow(cut, "block long, shard long, hashes binary, counts binary")
    counted = spread(shards, "shard").groupBy("shard").applyInPandas(add, "block long, shard long, n binary")
    own, counted = (spread(x, "block") for x in (own.select("block", "ends", "at", "leaves"), counted))
    return own.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(sum_up, "block long, place int, within double")


def fit(encoded: DataFrame, totals: np.ndarray | None = None) -> np.ndarray:
    """Weights learned from all encoded texts: SIZE of the network, then HIDDEN for every node of the trees."""
    vector = fresh()
    if totals is not None and len(totals) > BUCKETS:
        vector = np.concatenate((vector, np.zeros(len(totals) * HIDDEN, np.float32)))
    for turn in range(ROUNDS):
        vector = train_round(encoded, vector, turn, totals)
    return vector


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row of ``docs``."""
    _, blocks = encoded_blocks(keyed_text(docs))
    texts = blocks.where("tokens is not null").select("doc_id", "tokens", "codes", "block", "place")
    sizes = leaf_totals(blocks)
    shared = docs.sparkSession.sparkContext.broadcast((fit(texts.select("doc_id", "tokens", "codes"), sizes[0]), sizes[0]))

    def make():
        vector, totals = shared.value
        p, trees = unpack(vector), Trees(totals, vector[SIZE:]) if len(totals) > BUCKETS else None

        def work(batch):
            ids, n = bordered(batch.column(1).to_pylist())
            codes = bordered(batch.column(2).to_pylist())[0] if trees else None
            total = sums(log_probs(p, ids, places(n), trees, codes), np.cumsum(n))
            return {"doc_id": batch.column(0), "n_tokens": n, "of_leaves": total, "block": batch.column(3), "place": batch.column(4)}

        return work

    out = map_batches(texts, make, "doc_id long, n_tokens long, of_leaves double, block long, place int", column="tokens")
    out = out.join(within_classes(blocks, sizes), ["block", "place"])
    out = out.select("doc_id", "n_tokens", (F.col("of_leaves") + F.col("within")).alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
