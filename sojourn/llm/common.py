"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared ``spark.checkpoint.dir``
    and read it back: computed once, lineage cut, survives a lost executor. Removed when the
    application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the operators' own names, so that extra
    or clashing columns of the input never reach an operator. Null text: empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def own_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 18
                  ) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more than ``max_bytes`` of
    ``column``: long texts then never pile up in a Python worker, and arrays over a
    batch stay within the processor's cache."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if n == 0:
            continue
        i = batch.schema.get_field_index(column)
        if batch.column(i).nbytes <= max_bytes:
            yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(i)).to_pylist()
        size = 0
        for k in range(n):
            size += lengths[k] or 0
            if size >= max_bytes:
                yield batch.slice(at, k + 1 - at)
                at, size = k + 1, 0
        if at < n:
            yield batch.slice(at, n - at)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, make: Callable, schema: str | T.StructType, column: str = "text",
                max_bytes: int = 1 << 18) -> DataFrame:
    """``df.mapInArrow`` over batches small by ``column``. ``make()`` runs once per task and
    returns a function from a record batch to a dict of columns (or None)."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.names

    def run(batches):
        import pyarrow.compute  # noqa: F401  (binary_length)

        types = arrow_schema(out)
        work = make()
        for batch in small_batches(batches, column, max_bytes):
            cols = work(batch)
            if cols is not None and len(cols[names[0]]):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=types.field(n).type)
                     for n, c in ((n, cols[n]) for n in names)], schema=types)

    return df.mapInArrow(run, out)


def filter_rows(df: DataFrame, make: Callable, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` (all columns) for which the function that ``make()``
    returns, given the texts of a small batch (null: empty), says True."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        keep = make()
        for batch in small_batches(batches, text_col):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            mask = pa.array([bool(k) for k in keep(texts)], type=pa.bool_())
            out = batch.filter(mask)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, df.schema)
