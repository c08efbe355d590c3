"""Operator 13, MinHash near-dedup with tensored banding.

A document is the set of its distinct 2-word shingles; two are linked at a Jaccard similarity
of at least 0.8. Sets that are equal are one node of the search.

Tensored banding. A classic index of L tables of K minhashes each takes L * K of them. Here two
collections of SIDE sub-keys, each of PART minhashes, are computed (2 * SIDE * PART = 72), and
every pair of a sub-key of the one and of the other is a table key: 144 tables of 6
minhashes (864). Two sets of similarity s meet unless one collection has no common sub-key:
with probability 1 - (1 - (1 - (1 - s^PART)^SIDE)^2), 0.9996 at 0.8, over 0.999999 from 0.9 on.
Sub-keys that no other node has cannot make a shared table key and are left out before pairs
are formed.

Candidates. A node's rank is how many nodes share its sub-keys: of a group of copies the
original ranks highest. In every bucket (nodes of one table key) the node of highest rank leads;
a node takes the highest leader of its buckets, and that one's leader in turn, so a group
hangs on one leader. Every node is compared with its leader on the full sets, which also gives
its difference: what only one of the two sets holds. Two sets of one leader are similar only if
their own difference is at most (100 - p) / (100 + p) of both sizes, so the differences from the
leader must overlap by what their sizes exceed that. Where a leader has a member not
similar to it, members are therefore joined by the rarest elements of their differences (prefix
and position filter), not with each other. Pairs of one bucket in two classes and of two
leaders are compared as they are. So what shares a key and is similar ends in one class,
without the pairs within a class or a leader's group. Members of a hot leader are dealt by salts.

Edge cases. Null text or no word: empty set, ``n_shingles`` 0, a class of its own. One word: that
word is the set. Null id: compared too; a class's id is its smallest non-null id, else null,
and a row with null id is never kept. Repeated rows: each gets its row, and each is
kept if its id is the class's. Empty table: no rows. Extra columns are ignored. Words, shingles
and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches, small_batches, written
from .components import components

#: Sub-keys of a collection, minhashes of a sub-key.
SIDE, PART = 12, 3
#: Pairs of one group in the comparison, about.
SALT_ROWS = 1024
#: Fixed value: A-Z to a-z.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LAST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Shingles:
    """Sets of hashes of the 2-word shingles of texts; hashes of words are remembered."""

    def __init__(self, most: int = 1 << 20):
        self.words, self.most = {}, most

    def _hash(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self.words[word] = xxh64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()  # ASCII white space only
        if len(self.words) > self.most:
            self.words.clear()
        known = self.words.get
        h = np.fromiter((known(w) or self._hash(w) for w in words), dtype=np.uint64, count=len(words))
        if len(h) == 1:
            return _mix(h + np.uint64(1))
        with np.errstate(over="ignore"):
            return np.unique(_mix(_mix(h[:-1]) * np.uint64(3) + h[1:]))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of ``percent`` %."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (multipliers[:, None] * shingles[None, at:at + 4096]).min(axis=1), out=out)
    return out


def sub_keys(shingles: np.ndarray, side: int, part: int) -> np.ndarray:
    """Sub-keys of the first collection, then of the second: one hash a sub-key."""
    own = minhashes(shingles, _odd(2 * side * part, 42)).reshape(2 * side, part)
    out = np.arange(1, 2 * side + 1, dtype=np.uint64)  # a sub-key is only compared with those of its place
    for k in range(part):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
    return out


def prints(docs: DataFrame, side: int, part: int) -> DataFrame:
    """(doc_id, th: hash of the text, n: size of the set, node: hash of the set, subs), written once."""

    def make():
        shingles = Shingles()

        def work(batch):
            import pyarrow as pa

            n, node, subs = [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    s = shingles.of(text)
                    n.append(len(s))
                    node.append(int((_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)) if len(s) else 0)
                    subs.append(sub_keys(s, side, part).view(np.int64) if len(s) else [])
            return {"doc_id": batch.column(0), "th": batch.column(1), "n": n, "node": node, "subs": subs}

        return work

    rows = keyed_text(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return written(map_batches(rows, make, "doc_id long, th long, n long, node long, subs array<long>"), "minhash")


def buckets(nodes: DataFrame, side: int) -> DataFrame:
    """(key, node, n, rank) of the table keys of nodes whose both sub-keys some other node has."""
    subs = nodes.select("node", "n", F.posexplode("subs").alias("place", "sub"))
    shared = subs.groupBy("sub").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    kept = subs.join(shared, "sub").groupBy("node", "n").agg(
        F.collect_list(F.struct("place", "sub")).alias("s"), F.sum("c").alias("rank"))  # 2 * side sub-keys at most
    one, two = (F.filter("s", lambda x: f(x["place"])) for f in (lambda p: p < side, lambda p: p >= side))
    keys = F.flatten(F.transform(one, lambda a: F.transform(two, lambda b: F.xxhash64(a["sub"], b["sub"]))))
    keyed = kept.select(F.explode(keys).alias("key"), "node", "n", "rank")
    shared = keyed.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return written(keyed.join(shared.select("key", "lead"), "key"), "buckets")


def texts_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): one text of every node in ``wanted``, found again by id and hash, written once."""
    which = rows.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "th")).alias("r"))
    which = which.select("node", F.col("r.id").alias("id"), F.col("r.th").alias("th"))
    own = keyed_text(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th"), "text")
    return written(own.join(which, ["id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")


def compared(pairs: DataFrame, texts: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """(u, v, nu, nv, linked, diff) of the (u, v) pairs whose sets are similar, or, with
    ``differences``, of all: sizes and what only one of the sets holds. Rows of a group follow the
    text they are compared with; a node with very many pairs is dealt into many groups."""
    pairs = written(pairs, "pairs")
    salts = max(1, -(-pairs.count() // SALT_ROWS))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    left = salted.select("u", "salt").distinct().join(texts, F.col("u") == F.col("node")).select(
        "u", "salt", F.lit(0).alias("row"), F.col("u").alias("v"), "text")
    right = salted.join(texts, F.col("v") == F.col("node")).select("u", "salt", F.lit(1).alias("row"), "v", "text")
    dealt = left.unionAll(right).repartition("u", "salt").sortWithinPartitions("u", "salt", "row").select("u", "row", "v", "text")
    schema = "u long, v long, nu long, nv long, linked boolean, diff array<long>"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        shingles, held = Shingles(), None
        types = pa.schema([(c, pa.int64()) for c in ("u", "v", "nu", "nv")] + [("linked", pa.bool_()), ("diff", pa.list_(pa.int64()))])
        for batch in small_batches(batches):
            out = []
            for u, row, v, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()).to_pylist()):
                s = shingles.of(text)
                if row == 0:
                    held = s
                elif (linked := similar(held, s, percent)) or differences:
                    diff = np.setxor1d(held, s, assume_unique=True).view(np.int64) if differences else []
                    out.append((u, v, len(held), len(s), linked, diff))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], schema=types)

    return written(dealt.mapInArrow(run, schema), "compared")


def leaders(table: DataFrame) -> DataFrame:
    """(node, lead) of every node in ``table``: the highest leader that its buckets offer, and up
    from there to a node that leads itself."""
    found = table.groupBy("node").agg(F.max("lead").alias("lead")).select("node", F.col("lead.node").alias("lead"))
    while True:
        found = written(found, "leaders")
        up = found.select(F.col("node").alias("lead"), F.col("lead").alias("above"))
        if not found.where("node <> lead").join(up, "lead").where("above <> lead").take(1):
            return found
        found = found.join(up, "lead").select("node", F.col("above").alias("lead"))


def same_lead_pairs(first: DataFrame, percent: int) -> DataFrame:
    """(u, v) pairs of one leader's members, not both similar to it, whose differences from it can
    overlap enough."""
    groups = first.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("linked").alias("all")).where("c > 1 and not all")
    rows = first.join(groups.select("u"), "u", "left_semi").withColumn("k", F.size("diff"))
    each = rows.select("u", "v", F.explode("diff").alias("e"))
    often = each.groupBy("u", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = each.join(often, ["u", "e"]).groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s"))  # one set's
    # the overlap that any similar pair with v has at least: by v's size, and if v is similar to
    # the leader, by what the partner's difference must be at least
    by_size = F.col("k") - F.col("nv") * (100 - percent) / F.lit(percent)
    by_lead = (F.col("k") + (F.col("nu") - F.col("nv")) * F.lit((100 - percent) / (100 + percent))) / 2
    least = F.greatest(F.lit(1.0), by_size, F.when(F.col("linked"), by_lead).otherwise(F.lit(1.0))) - 1e-6
    rows = rows.select("u", "v", "nv", "linked", "k", least.alias("least")).join(shared, ["u", "v"])
    rows = rows.withColumn("alone", F.col("k") - F.size("s"))  # elements that no other member has come first
    rows = rows.select("u", "v", "nv", "linked", "k", "alone", "least", F.posexplode("s").alias("at", "x"))
    rows = rows.select("u", F.col("x.e").alias("e"), "v", F.col("nv").alias("n"), "linked", "k",
                       (F.col("k") - F.col("alone") - F.col("at")).alias("left"), "least").where("left >= least").drop("least")
    rows = written(rows, "differences")
    other = rows.select("u", "e", *(F.col(c).alias(f"{c}2") for c in ("v", "n", "linked", "k", "left")))
    near = rows.join(other, ["u", "e"]).where(
        (F.col("v") < F.col("v2")) & ~(F.col("linked") & F.col("linked2"))
        & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
        & (2 * (100 + percent) * F.least("left", "left2") >= (100 + percent) * (F.col("k") + F.col("k2")) - (100 - percent) * (F.col("n") + F.col("n2"))))
    return near.select(F.col("v").alias("u"), F.col("v2").alias("v")).distinct()


def cross_pairs(table: DataFrame, lead: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of one bucket in two classes and of two leaders, near enough in size."""
    rows = table.select("key", "node", "n").join(lead, "node").join(roots, "node", "left").select(
        "key", "node", "n", "lead", F.coalesce("root", "node").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("lead").alias("l1"),
                                      F.max("lead").alias("l2")).where("lo < hi and l1 < l2").select("key")
    rows = written(rows.join(several, "key"), "several")
    main = rows.groupBy("key", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "lead")).alias("m")).select("key", F.col("m.lead").alias("main"))
    rows = rows.join(main, "key")
    rest = rows.where("lead <> main").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"),
                                             F.col("lead").alias("lx"))
    pairs = rest.join(rows, "key").where((F.col("rx") != F.col("root")) & (F.col("lx") != F.col("lead"))
                                         & ((F.col("lead") == F.col("main")) | (F.col("x") < F.col("node")))
                                         & (100 * F.least("nx", "n") >= percent * F.greatest("nx", "n")))
    return pairs.select(F.least("x", "node").alias("u"), F.greatest("x", "node").alias("v")).distinct()


def classes(docs: DataFrame, rows: DataFrame, side: int, percent: int) -> DataFrame:
    """(node, component_id) of every distinct set but the empty one."""
    nodes = rows.where("n > 0").groupBy("node", "n", "subs").agg(F.min("doc_id").alias("least"))
    table = buckets(nodes, side)
    lead = leaders(table)
    texts = texts_of(docs, rows, lead.select("node"))
    first = compared(lead.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")), texts, percent, True)
    roots = written(components(first.where("linked")), "roots")
    more = compared(same_lead_pairs(first, percent).union(cross_pairs(table, lead, roots, percent)).distinct(), texts, percent)
    named = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
    joined = more.join(named("u", "ru"), "u", "left").join(named("v", "rv"), "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    above = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = rooted.join(above, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("node", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 80, side: int = SIDE, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = prints(docs, side, part)
    told = rows.select("doc_id", "n", "node").join(classes(docs, rows, side, percent), "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                       F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def documents_sql(percent: int = 80) -> str:
    """The same rows by comparing every pair of documents that shares a shingle."""
    return f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
  from words),
each_one as (select doc_id, len(s) as n, unnest(s) as g from sets),
near as (
  select a.doc_id as u, b.doc_id as v from each_one a join each_one b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach as (
  select doc_id as u, doc_id as v from sets
  union
  select reach.u, near.v from reach join near on reach.v = near.u),
least as (select u, min(v) as component_id from reach group by u)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join least on doc_id = u"""
