"""Operator 4, document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever it is -1 modulo the
block size; each piece adds one sign of its checksum to the signature. The block
size is 3 * 2^k, the smallest for which about SIGNATURE pieces are expected,
halved while the signature is shorter than half of that; a second signature uses
twice the block size. The fingerprint is ``size:signature:second``. Two
fingerprints are compared at equal block sizes (or one's second with the other's
first): 1 - (insertions + deletions) / (both lengths), the edit distance being
taken bit-parallel; 0 without a common run of MIN_RUN signs; 1 if equal.

``with_edits`` also builds each text's edited form, which needs the next text in
descending id. The texts are range partitioned and sorted on (id, text): one shuffle, no window over
the table. Each row meets the row after it in its partition's stream; a partition's last
row meets the first of the next partition, in a table of two rows a partition.

Edge cases. Null or empty text: empty, fingerprint ``3::``. Null id: sorts after all
ids. Repeated ids: ordered by text; each row is returned. One row: its own next.
Empty table: no rows. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, keyed_text, small_batches, written

WINDOW, SIGNATURE, MIN_RUN = 7, 64, 3
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: bytes) -> np.ndarray:
    """Rolling hash plus one at every byte: the sum and the weighted sum of the
    window, plus its shifted exclusive or (32 bits)."""
    a = np.frombuffer(b"\0" * (WINDOW - 1) + data, dtype=np.uint8).astype(np.uint32)
    n = len(data)
    total, mixed = np.ones(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    for back in range(WINDOW):
        x = a[WINDOW - 1 - back:WINDOW - 1 - back + n]
        total += x * np.uint32(WINDOW + 1 - back)
        mixed ^= x << np.uint32(5 * back)
    return total + mixed


def signature(data: memoryview, ends: np.ndarray, most: int) -> str:
    """One sign for each piece; all beyond ``most`` - 1 pieces is one piece."""
    out, at = [], 0
    for end in ends[:most - 1].tolist():
        out.append(SIGNS[zlib.crc32(data[at:end]) & 63])
        at = end
    if at < len(data):
        out.append(SIGNS[zlib.crc32(data[at:]) & 63])
    return "".join(out)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text (rolled over together, seven zero bytes apart)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    rolled = rolling((b"\0" * WINDOW).join(data))
    out, at = [], 0
    for b in data:
        out.append(_fingerprint(b, rolled[at:at + len(b)]))
        at += len(b) + WINDOW
    return out


def _fingerprint(data: bytes, rolled: np.ndarray) -> str:
    def ends(k):
        at = np.flatnonzero((rolled & np.uint32((1 << k) - 1)) == 0)
        return at[rolled[at] % 3 == 0] + 1

    k = 0
    while 3 * (1 << k) * SIGNATURE < len(data):
        k += 1
    cuts = ends(k)
    while k and len(cuts) < SIGNATURE // 2:
        k -= 1
        cuts = ends(k)
    view = memoryview(data)
    second = cuts[(rolled[cuts - 1] >> np.uint32(k)) % 2 == 0] if len(cuts) else cuts
    return f"{3 << k}:{signature(view, cuts, SIGNATURE)}:{signature(view, second, SIGNATURE // 2)}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _near(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    run = min(MIN_RUN, len(a), len(b))
    grams = {a[k:k + run] for k in range(len(a) - run + 1)}
    if not any(b[k:k + run] in grams for k in range(len(b) - run + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: how alike the texts behind two fingerprints are."""
    if x == y:
        return 1.0
    (n, a, a2), (m, b, b2) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_near(a, b), _near(a2, b2))
    return _near(a, b2) if n == 2 * m else _near(a2, b) if m == 2 * n else 0.0


LAST = -(1 << 63)  # where null ids sort


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def edited_rows(rows: list[tuple]) -> list[tuple]:
    """Result rows of (id, text, fingerprint, next text, next fingerprint)."""
    edited = [text[:len(text) - len(text) // 2] + after[:len(text) // 2] for _, text, _, after, _ in rows]
    changed = fingerprints(edited)
    return [(doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own, c, likeness(own, c), likeness(own, near))
            for (doc, text, own, _, near), e, c in zip(rows, edited, changed)]


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs``."""
    texts = keyed_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("head", F.substring("text", 1, 64))
    dealt = texts.repartitionByRange(F.desc("key"), "head").sortWithinPartitions(F.desc("key"), "text").select("doc_id", "text")
    schema = T._parse_datatype_string(RESULT + ", part long, edge string, text string")

    def run(batches):
        """Rows in order; ``edge`` marks the partition's first row and its last, which has no result yet."""
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        types, part, held = arrow_schema(schema), TaskContext.get().partitionId(), None
        edge = lambda kind, row: (row[0], *[None] * (len(NAMES) - 1), part, kind, row[1])
        for batch in small_batches(batches):
            doc, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not own:
                continue
            prints, out, rows = fingerprints(own), [], []
            if held is None:
                out.append(edge("first", (doc[0], own[0])))
            for row in zip(doc, own, prints):
                if held is not None:
                    rows.append((*held, row[1], row[2]))
                held = row
            out += [(*r, part, None, None) for r in edited_rows(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)] if out else
                                             [pa.array([], t.type) for t in types], schema=types)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(edge("last", held), types)], schema=types)

    found = written(dealt.mapInArrow(run, schema), "edits")
    order = Window.orderBy("part")  # two rows a partition
    last = found.where("edge = 'last'").select("doc_id", "text", F.row_number().over(order).alias("k"),
                                               F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    first = found.where("edge = 'first'").select(F.col("text").alias("after"), F.row_number().over(order).alias("k1"))
    ends = last.join(first, F.col("k1") == F.col("k") % F.col("n") + 1).select("doc_id", "text", "after")

    def finish(batches):
        for pdf in batches:
            for doc, text, after in zip(pdf["doc_id"], pdf["text"], pdf["after"]):  # few rows, long texts one by one
                row = edited_rows([(None if pd.isna(doc) else int(doc), text, *fingerprints([text]), after, *fingerprints([after]))])[0]
                yield pd.DataFrame([row], columns=NAMES).astype({"doc_id": "Int64"})

    return found.where("edge is null").select(*NAMES).unionByName(ends.mapInPandas(finish, RESULT))
