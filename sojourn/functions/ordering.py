"""Position, previous value and running sum within a group, without putting a
whole group into one window task.

A plain ``Window.partitionBy(user).orderBy(t)`` sends every row of a user to a
single task; one user may own a third of a trace. Here the input is evaluated once (written,
so that its size is known), range partitioned on the group and the full order key into
partitions of about PARTITION_BYTES, whatever the values are (one outlier or a burst does not widen
a partition), and sorted. One pass over each sorted partition numbers the rows, adds up and
carries the previous value, batch by batch. What a partition lacks is what stands before it of
the one group that reaches over its border: these offsets are at most two rows a partition, and
are added by a broadcast join. The result is exact for any partition size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In-memory bytes of a partition.
PARTITION_BYTES = 128 << 20
#: Rows of a partition; None: by bytes.
DEFAULT_BLOCK_ROWS: int | None = None
WIDTHS = {T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.IntegerType: 4, T.FloatType: 4, T.BooleanType: 1}


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row in memory, about: 8 a fixed-width column at most, 20 and its offset a string."""
    return 8 + sum(WIDTHS.get(type(f.dataType), 28) for f in schema)


def sorted_ranges(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  block_rows: int | None = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(``df`` in sorted range partitions on (group, order columns), their number). ``df`` is
    evaluated once; the sample for the bounds and the exchange read what was written."""
    rows = materialize(df)
    n = rows.count()
    parts = max(1, -(-n // int(block_rows)) if block_rows else -(-n * row_bytes(df.schema) // PARTITION_BYTES))
    dealt = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *group_cols, *order_cols)
    return dealt.sortWithinPartitions(*group_cols, *order_cols), parts


def range_blocks(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], block_rows: int) -> DataFrame:
    """``df`` with ``_blk``: blocks of at most ``block_rows`` rows that follow the order of (group,
    order columns), cut inside the sorted partitions. Written once, so that every later use
    sees the same blocks."""
    dealt, _ = sorted_ranges(df, group_cols, order_cols)
    at = F.monotonically_increasing_id()  # partition * 2^33 + row
    row = at.bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(dealt.withColumn("_blk", at - row + F.floor(row / int(block_rows))))


def _numbering(g: list[str], idx_col, sum_col, prefix_col, prev_of, prev_col, first_of, first_col, schema: T.StructType):
    """One pass over a sorted partition; ``carry`` is the last row's group and what it has seen."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        types, part, carry = to_arrow_schema(schema), TaskContext.get().partitionId(), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            new = np.zeros(n, dtype=bool)
            for c in g:
                new[1:] |= pc.not_equal(cols[c].slice(1), cols[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head = tuple(cols[c][0].as_py() for c in g)
            new[0] = carry is None or carry["group"] != head
            carry = {"rows": 0, "sum": 0, "last": None, "first": None} if new[0] else carry
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, 0))
            going = np.cumsum(new) == 0  # rows of the group that the batch before ended with
            idx = at - start + np.where(going, carry["rows"], 0)
            cols[idx_col] = pa.array(idx, pa.int64())
            total = 0
            if sum_col is not None:
                v = pc.fill_null(cols[sum_col], 0).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                pre = before - before[start] + np.where(going, carry["sum"], 0)
                cols[prefix_col] = pa.array(pre, pa.int64())
                total = int(pre[-1] + v[-1])
            last = first = None
            if prev_of is not None:
                own = cols[prev_of]
                shifted = pa.concat_arrays([pa.array([carry["last"]], own.type), own.slice(0, n - 1)])
                cols[prev_col] = pc.if_else(pa.array(new), pa.scalar(None, own.type), shifted)
                last = own[n - 1].as_py()
            if first_of is not None:
                own = cols[first_of]
                found = pc.if_else(pa.array(going), pa.scalar(carry["first"], own.type), own.take(pa.array(start)))
                cols[first_col] = found
                first = found[n - 1].as_py()
            cols["_part"] = pa.array(np.full(n, part), pa.int64())
            carry = {"group": tuple(cols[c][n - 1].as_py() for c in g), "rows": int(idx[-1]) + 1, "sum": total, "last": last, "first": first}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in types], schema=types)

    return run


def ordered_index(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    *,
    idx_col: str = "idx",
    sum_col: str | None = None,
    prefix_col: str = "pre",
    prev_of: str | None = None,
    prev_col: str = "prev",
    first_of: str | None = None,
    first_col: str = "first",
    block_rows: int | None = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Add ``idx_col`` = 0-based rank of the row inside its group under
    ``order_cols`` (ties broken arbitrarily: pass a unique order).

    Optional: ``prefix_col`` = sum of ``sum_col`` over the rows strictly before
    (0 for the first row); ``prev_col`` = ``prev_of`` of the previous row
    (NULL for the first row); ``first_col`` = ``first_of`` of the group's
    first row. Rows with a NULL group are left out. The result is written: callers may read it
    several times.
    """
    g = list(group_cols)
    for c in g:
        df = df.where(F.col(c).isNotNull())
    dealt, parts = sorted_ranges(df, g, list(order_cols), block_rows)
    schema = T.StructType(list(df.schema)).add(idx_col, "long")
    if sum_col is not None:
        schema = schema.add(prefix_col, "long")
    if prev_of is not None:
        schema = schema.add(prev_col, df.schema[prev_of].dataType)
    if first_of is not None:
        schema = schema.add(first_col, df.schema[first_of].dataType)
    names = schema.names
    schema = schema.add("_part", "long")
    d = materialize(dealt.mapInArrow(_numbering(g, idx_col, sum_col, prefix_col, prev_of, prev_col, first_of, first_col, schema), schema))
    if parts == 1:
        return d.drop("_part")

    # groups on several partitions: what stands before each of their partitions
    aggs = [F.count(F.lit(1)).alias("_n")]
    if sum_col is not None:
        aggs.append(F.sum(sum_col).alias("_s"))
    if prev_of is not None:
        aggs.append(F.max_by(prev_of, idx_col).alias("_l"))
    if first_of is not None:
        aggs.append(F.min_by(first_of, idx_col).alias("_f"))
    per = d.groupBy(*g, "_part").agg(*aggs)
    w = Window.partitionBy(*g).orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*g, "_part", F.count(F.lit(1)).over(Window.partitionBy(*g)).alias("_k"), F.sum("_n").over(before).alias("_off")]
    if sum_col is not None:
        cols.append(F.sum("_s").over(before).alias("_soff"))
    if prev_of is not None:
        cols.append(F.lag("_l").over(w).alias("_pl"))
    if first_of is not None:
        cols.append(F.first("_f").over(w).alias("_f0"))
    off = per.select(*cols).where((F.col("_k") > 1) & F.col("_off").isNotNull()).drop("_k")
    d = d.join(F.broadcast(off), [*g, "_part"], "left")  # at most two rows a partition
    out = {idx_col: F.col(idx_col) + F.coalesce("_off", F.lit(0))}
    if sum_col is not None:
        out[prefix_col] = F.col(prefix_col) + F.coalesce("_soff", F.lit(0))
    if prev_of is not None:
        out[prev_col] = F.when((F.col(idx_col) == 0) & F.col("_off").isNotNull(), F.col("_pl")).otherwise(F.col(prev_col))
    if first_of is not None:
        out[first_col] = F.when(F.col("_off").isNotNull(), F.col("_f0")).otherwise(F.col(first_col))
    return d.select(*(out.get(c, F.col(c)).alias(c) if c in out else F.col(c) for c in names))


def compute_partitions(spark, units: int, per_task: int = 4) -> int:
    """Partitions for compute-heavy stages whose input is small in bytes, so that
    AQE's size-based coalescing cannot pack many expensive units into one task:
    ``per_task`` units of work each, and while there are few units, up to two
    partitions per core."""
    return max(1, -(-units // per_task), min(units, 2 * spark.sparkContext.defaultParallelism))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared ``spark.checkpoint.dir`` folder
    and read it back: one computation, survives executor loss, cuts lineage.
    Used where a frame feeds several later passes. The files are removed at the end of
    the ``session.scratch_scope`` they were written in, else when the application ends."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, "mat")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
