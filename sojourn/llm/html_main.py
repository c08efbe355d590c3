"""Operator 3, HTML extraction with a suffix array over each host's pages.

A page is cut into text blocks. Markup that says what a block is proposes the article: what
stands in menus, footers, forms, adverts, comments and the like goes; where an article
container is named, the blocks are those within it. The token streams of these blocks of all
pages, with a container or without, are their host's text. Every suffix of it counts by its
first RUN tokens, and sorting the suffixes by that prefix is the host's suffix array cut at
depth RUN, spread over the cluster: a long substring is repeated exactly where all its
RUN-token windows are. Neighbours with the same prefix on distinct pages (copies of a page
count once) cover boilerplate; a block with a share of COVERED or more of its tokens under
them is removed, the unique runs of blocks stay.

How many pages it takes. Where no container says where the article is, two of such pages (what
a container holds elsewhere may be the same article). Within a container, whose prose pages may
share, a template's: at least PAGES pages and SHARE of the distinct pages of the host, with
containers or without; and where more than MOST of a page's tokens would go, the page is itself
a copy and keeps its blocks. Menus and adverts may be unique to a page, and articles
may be copied within a host, so repetition alone would keep the one and drop the other.

Which suffixes are sorted. Of each window of RUN tokens the least hash of SEED tokens in it is
its seed; a page has few distinct ones (one for about five tokens). Windows that are equal have equal seeds,
so a window is on no more pages than its seed: seeds on too few pages are dropped first, and
every suffix with a seed that stays goes into the array. No window on enough pages is lost.

Edge cases. Null or empty html: empty text. Null url: host "". Null id: kept.
Repeated rows: each is returned; they count as one page. A page of which nothing
would stay keeps its blocks. Truncated or broken markup is read to its end. Empty
table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

#: Tokens of a repeated run, and the share of a block's tokens that must be covered.
RUN, COVERED = 12, 0.8
#: Tokens of a seed.
SEED = 4
#: Within a container: pages and share of the host's pages that a template's run stands on, and the
#: share of a page's tokens above which nothing is removed.
PAGES, SHARE, MOST = 5, 0.5, 0.5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def joined(texts: list[str]) -> str:
    return "\n\n".join(texts)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, block) of each token of the page's token stream."""
    from xxhash import xxh64_intdigest

    tokens, block = [], []
    for k, t in enumerate(texts):
        own = t.split(" ")
        tokens += own
        block += [k] * len(own)
    h = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tokens], dtype=np.uint64)
    return h, np.array(block, dtype=np.int64)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each place."""
    n = len(h) - size + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            code = code * MULTIPLIER + h[k:k + n]
    return code


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the RUN tokens from each place of the page's token stream, block of each token)."""
    h, block = hashed(texts)
    return windows(h, RUN).view(np.int64), block


def seeds(h: np.ndarray, host: str) -> np.ndarray:
    """The seed of the RUN tokens from each place, told apart by host."""
    from xxhash import xxh64_intdigest

    if len(h) < RUN:
        return np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(windows(h, SEED), RUN - SEED + 1).min(axis=1)
    with np.errstate(over="ignore"):
        return (least * MULTIPLIER ^ np.uint64(xxh64_intdigest(host.encode("utf-8", "surrogatepass")))).view(np.int64)


def keep_unique(texts: list[str], repeated: list[int], most: float = 1.0) -> list[str]:
    """The blocks that windows at the ``repeated`` places do not cover; all where nothing would
    stay or more than ``most`` of the tokens would go."""
    if not repeated:
        return texts
    block = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 for t in texts])
    edge = np.zeros(len(block) + 1, dtype=np.int64)
    at = np.unique(np.asarray(repeated, dtype=np.int64))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + RUN, -1)
    covered = np.cumsum(edge[:-1]) > 0
    size = np.bincount(block, minlength=len(texts))
    gone = np.bincount(block, weights=covered, minlength=len(texts)) / size >= COVERED
    if gone.all() or size[gone].sum() > most * len(block):
        return texts
    return [t for t, g in zip(texts, gone) if not g]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, told) of every page: the blocks that its markup proposes, one a line
    (blocks hold no line feed), and whether a container held them."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"))

    def read():
        from .html_blocks import blocks, choose

        def work(batch):
            p, u, h = (batch.column(k).to_pylist() for k in range(3))
            found = [choose(blocks(x)) for x in h]
            return {"page_id": p, "url": u, "text": ["\n".join(t) for t, _ in found], "told": [told for _, told in found]}

        return work

    return map_batches(own, read, "page_id long, url string, text string, told boolean")


def repeated_seeds(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``texts`` (host, page, told, text), ``needed`` (host, need) -> (page, seeds): of every page the seeds that
    stand on two distinct pages without a container or (of repeated pages each counts) on ``need`` rows."""

    def sampled():
        def work(batch):
            out = {"seed": [], "page": [], "told": []}
            for h, p, told, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = np.unique(seeds(hashed(t.split("\n"))[0], h))
                out["seed"].append(own)
                out["page"].append(np.full(len(own), p, dtype=np.int64))
                out["told"].append(np.full(len(own), told))
            return {k: np.concatenate(v) for k, v in out.items()}

        return work

    same = Window.partitionBy("seed")
    free = F.expr("if(told, null, page)")
    shared = (map_batches(texts.select("host", "page", "told", "text"), sampled, "seed long, page long, told boolean")
              .select("seed", "page", F.coalesce(F.min(free).over(same) < F.max(free).over(same), F.lit(False)).alias("free"),
                      F.count("*").over(same).alias("rows"))
              .where(F.col("free") | (F.col("rows") >= PAGES)).dropDuplicates(["seed", "page"]))  # copies of a page
    return (shared.join(texts.select("page", "host").distinct(), "page").join(needed, "host")
            .where("free or rows >= need").groupBy("page").agg(F.collect_list("seed").alias("seeds")))


def repeated_places(texts: DataFrame, found: DataFrame, needed: DataFrame) -> DataFrame:
    """(page, places, template): where windows begin that stand on two distinct pages of the host without a
    container, and in one with a container those on the ``need`` of all. ``found``: the pages' repeated seeds."""

    def suffixes():
        def work(batch):
            out = {"host": [], "page": [], "told": [], "place": [], "run": []}
            for h, p, told, t, own in zip(*(batch.column(k).to_pylist() for k in range(5))):
                token, _ = hashed(t.split("\n"))
                at = np.flatnonzero(np.isin(seeds(token, h), np.array(own, dtype=np.int64)))
                out["host"] += [h] * len(at)
                out["page"] += [p] * len(at)
                out["told"] += [told] * len(at)
                out["place"] += at.tolist()
                out["run"] += windows(token, RUN).view(np.int64)[at].tolist()
            return out

        return work

    rows = texts.join(found, "page").select("host", "page", "told", "text", "seeds")
    array = map_batches(rows, suffixes, "host string, page long, told boolean, place int, run long").distinct()  # copies count once
    same, alike = Window.partitionBy("host", "run"), Window.partitionBy("host", "run", "told")
    counted = (array.withColumn("nth", F.dense_rank().over(same.orderBy("page"))).withColumn("pages", F.max("nth").over(same))
               .withColumn("nth", F.dense_rank().over(alike.orderBy("page"))).withColumn("alike", F.max("nth").over(alike))
               .join(needed, "host").where("if(told, pages >= need, alike > 1)"))
    return counted.groupBy("page").agg(F.collect_list(F.expr("if(told, null, place)")).alias("places"),
                                       F.collect_list(F.expr("if(told, place, null)")).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> (page_id, url, text, n_chars), one row for each."""
    # Every page is parsed once; the texts are written.
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    texts = written(parsed(pages), "pages", compression="zstd").withColumn("host", host).withColumn("page", F.xxhash64("host", "text"))
    filled = texts.where("text != ''")
    needed = written(filled.groupBy("host").agg(F.count_distinct("page").alias("pages"))
                     .select("host", F.greatest(F.lit(PAGES), F.ceil(F.col("pages") * SHARE)).cast("long").alias("need")), "hosts")
    found = written(repeated_seeds(filled, needed), "seeds")
    covered = written(repeated_places(filled, found, needed), "places")

    def unique():
        def work(batch):
            p, u, t, told, places, template = (batch.column(k).to_pylist() for k in range(6))
            kept = [keep_unique(x.split("\n"), *((c, MOST) if b else (a,))) for x, b, a, c in zip(t, told, places, template)]
            return {"page_id": p, "url": u, "text": [joined(x) for x in kept]}

        return work

    rows = texts.join(covered, "page", "left").select("page_id", "url", "text", "told", "places", "template")
    return map_batches(rows, unique, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
