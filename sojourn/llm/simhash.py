"""Operator 7, SimHash near-dedup with BK-trees.

Fingerprints of equal value are one node of the search. A pair within ``radius``
bits agrees on at least two of ``radius + 2`` bands of the 64 bits, so each
fingerprint goes to one shard per pair of bands (key: the bits of both); a
BK-tree per shard - children keyed by their Hamming distance to the parent -
finds all pairs, following only edges within the radius. Trees are built where
their shard's rows are shuffled to, not broadcast: their total grows with the
corpus. Shards are counted before any row is shuffled to one. Within a shard of more
than SHARD_ROWS a pair's differing bits lie outside the two bands, so it agrees on at
least one of ``radius + 1`` bands of the other bits: such a shard is keyed again by each of
these. What is still larger is dealt into parts, and each pair of parts is searched by
itself. Every shard returns a spanning star of what it linked; connected components
over those links give the classes.

Edge cases. Null text or no word: fingerprint zero, linked like any other.
Null id: fingerprinted; a class's id is its smallest non-null id, else null.
Repeated rows: each gets its row. Empty table: no rows. Extra columns are ignored
(``keep_one`` returns them untouched).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches, own_name, written
from .components import components

#: Rows a shard may have before it is dealt into parts.
SHARD_ROWS = 4096
#: Fixed value: A-Z to a-z.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.root = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while d := (value ^ x).bit_count():
            if d not in children:
                children[d] = (x, {})
                return
            value, children = children[d]

    def within(self, x: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            value, children = open_.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                open_ += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


def star_links(tree_of: list[int], ask: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is within ``radius`` of each other: pairs of the
    tree's values and the asked values (and, if ``ask`` is empty, within the
    tree's values), as a star around each class's smallest value."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = BKTree()
    for x in tree_of:
        if not ask:
            for y in tree.within(x, radius):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
        tree.add(x)
    for x in ask:
        for y in tree.within(x, radius):
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def band_masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """(the bits of every pair of bands; for each, these bits with each band of the other bits)."""
    bands = radius + 2
    cuts = [64 * k // bands for k in range(bands + 1)]
    masks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(bands)]
    pairs = [a | b for a, b in combinations(masks, 2)]
    finer = []
    for pair in pairs:
        rest = [k for k in range(64) if not pair >> k & 1]
        ends = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
        finer.append([pair | sum(1 << k for k in rest[a:b]) for a, b in zip(ends, ends[1:])])
    return pairs, finer


def by_size(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(band, key, fp) -> (rows of shards of at most SHARD_ROWS; those of larger ones with their size ``n``, or
    None). Sizes are counted with partial sums; the few large keys are joined by their written size."""
    hot = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
    hot = written(hot, "large")
    if hot.isEmpty():
        return keyed, None
    return keyed.join(hot, ["band", "key"], "left_anti"), keyed.join(hot, ["band", "key"])


def links_in_shards(keyed: DataFrame, radius: int) -> DataFrame:
    """(u, v) links within shards (band, key) of at most SHARD_ROWS."""
    mask = (1 << 64) - 1

    def search(batches):
        """Rows come sorted by shard."""
        import pandas as pd

        held, held_key = [], None

        def links():
            return [(signed(a), signed(b)) for a, b in star_links([x & mask for x in held], [], radius)] if len(held) > 1 else []

        for pdf in batches:
            out = []
            for key, fp in zip(zip(pdf["band"].tolist(), pdf["key"].tolist()), pdf["fp"].tolist()):
                if key != held_key:
                    out += links()
                    held, held_key = [], key
                held.append(fp)
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        if out := links():
            yield pd.DataFrame(out, columns=["u", "v"])

    return keyed.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInPandas(search, "u long, v long")


def links_between_parts(large: DataFrame, radius: int) -> DataFrame:
    """(u, v) links within larger shards: parts i <= j of about SHARD_ROWS, each pair a group of its own."""
    mask = (1 << 64) - 1
    parts = large.withColumn("parts", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    pairs = (parts.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"))

    def search(key, pdf):
        import pandas as pd

        i, j = key[2], key[3]
        tree = [x & mask for x in sorted(pdf.loc[pdf["own"] == i, "fp"].tolist())]
        ask = [] if i == j else [x & mask for x in sorted(pdf.loc[pdf["own"] == j, "fp"].tolist())]
        found = star_links(tree, ask, radius) if i == j or ask else []
        return pd.DataFrame([(signed(a), signed(b)) for a, b in found], columns=["u", "v"]).astype("int64")

    return pairs.groupBy("band", "key", "i", "j").applyInPandas(search, "u long, v long")


def links_of(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct signed 64-bit ``fp`` -> (u, v) links whose components are those
    of all pairs within ``radius`` bits."""
    pairs, finer = band_masks(radius)
    fps = written(fps, "prints")  # counted, then searched
    masks = F.array(*(F.lit(signed(m)) for m in pairs))
    keyed = fps.select("fp", F.posexplode(masks).alias("band", "mask"))
    small, large = by_size(keyed.select("band", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"))
    links = links_in_shards(small, radius)
    if large is None:
        return links
    masks = F.array(*(F.array(*(F.lit(signed(m)) for m in ms)) for ms in finer))
    keyed = large.select("fp", "band", F.posexplode(F.element_at(masks, F.col("band") + 1)).alias("third", "mask"))
    small, large = by_size(keyed.select((F.col("band") * (radius + 1) + F.col("third")).alias("band"),
                                        F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"))
    links = links.unionAll(links_in_shards(small, radius))
    return links if large is None else links.unionAll(links_between_parts(large, radius))


def fingerprints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, th: hash of the text, fp: signed fingerprint), written once."""

    def make():
        def work(batch):
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], dtype="<u8")
            return {"doc_id": batch.column(0), "th": batch.column(1), "fp": fp.view("<i8")}

        return work

    rows = keyed_text(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return written(map_batches(rows, make, "doc_id long, th long, fp long"), "simhash")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links_of(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = fingerprints(docs, shingle, seed)
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row of every class (that of the smallest id; of repeated rows one);
    all columns. Rows are found again by id and hash of the text; whole rows are shuffled once,
    and of repeated rows one a task."""
    prints = fingerprints(docs, shingle, seed)
    kept = prints.join(classes(prints, radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("fp", "doc_id").agg(F.min("th").alias("hash"))
    key = own_name(docs, "_row")  # a struct is never null, so that a null id is a key like any other
    kept = kept.select(F.struct(F.col("doc_id").alias("id"), "hash").alias(key))
    own = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"),
                                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash")))
    return own.dropDuplicates([key]).join(kept, key, "left_semi").select(*docs.columns)
