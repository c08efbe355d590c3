"""Read task / job event logs from CSV (comma separated, ``NULL`` as the null
token, gzip or plain, one path, a glob or a list of paths).

Malformed rows (wrong field count, or a field that does not parse as its
type) are dropped. Unlike a typed read in DROPMALFORMED mode, whose result
depends on which columns a later query happens to read, every field is read
as a string and checked here, so the kept rows are the same for any
projection. Empty fields are NULL. Declared key fields stay nullable;
``require_keys=True`` drops rows whose key is NULL.

gzip files are not splittable (one task per file). ``read_once`` reads every file a single
time, for uses that need the events more than once: the parsed events are written and read back, and where a
file that cannot be split is longer than SPLIT_BYTES, its rows are dealt to all tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import JOB_DROPPED, JOB_EVENT_FIELDS, TASK_EVENT_FIELDS

CORRUPT = "_corrupt_record"
#: Longest file that one task reads and writes by itself, if it cannot be split.
SPLIT_BYTES = 64 << 20
NOT_SPLIT = (".gz", ".deflate", ".snappy", ".lz4", ".zst", ".xz")


def _read(spark: SparkSession, paths, fields, keys: Sequence[str], require_keys: bool) -> DataFrame:
    raw_schema = T.StructType(
        [T.StructField(n, T.StringType(), True) for n, _ in fields]
        + [T.StructField(CORRUPT, T.StringType(), True)]
    )
    raw = (
        spark.read.option("sep", ",")
        .option("nullValue", "NULL")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(raw_schema)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    typed = [
        (F.col(n) if isinstance(t, T.StringType) else F.col(n).try_cast(t)).alias(n) for n, t in fields
    ]
    # Every column is referenced (strings through a length test Catalyst does
    # not fold away): with CSV column pruning, a column no later query needs
    # is not parsed, and a row of wrong arity would no longer be flagged.
    ok = F.col(CORRUPT).isNull()
    for n, t in fields:
        if isinstance(t, T.StringType):
            ok = ok & (F.coalesce(F.length(F.col(n)), F.lit(0)) >= 0)
        else:
            ok = ok & (F.col(n).isNull() | F.col(n).try_cast(t).isNotNull())
    out = raw.where(ok).select(*typed)
    if require_keys:
        for k in keys:
            out = out.where(F.col(k).isNotNull())
    return out


def read_task_events(spark: SparkSession, paths, require_keys: bool = False) -> DataFrame:
    """13 columns of the task event table."""
    return _read(spark, paths, TASK_EVENT_FIELDS, ("timestamp", "jobid", "taskix", "evtype"), require_keys)


def read_job_events(spark: SparkSession, paths, require_keys: bool = False) -> DataFrame:
    """6 columns of the job event table (job name columns dropped)."""
    df = _read(spark, paths, JOB_EVENT_FIELDS, ("timestamp", "jobid", "evtype"), require_keys)
    return df.drop(*JOB_DROPPED)


def file_lengths(spark: SparkSession, paths) -> dict[str, int]:
    """Length of every file under the paths, globs or list, from one listing each."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, int] = {}
    for one in [paths] if isinstance(paths, str) else list(paths):
        path = jvm.org.apache.hadoop.fs.Path(one)
        fs = path.getFileSystem(conf)
        for status in fs.globStatus(path) or []:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                out[f.getPath().toString()] = f.getLen()
    return out


def read_once(spark: SparkSession, read, paths) -> DataFrame:
    """``read(spark, paths)``, evaluated once and written. Rows of long files that cannot be split are
    dealt by (job, time), so that neither the file nor a job with very many rows stays in one task."""
    from ..functions.ordering import materialize

    events = read(spark, paths)
    lengths = file_lengths(spark, paths)
    if any(n > SPLIT_BYTES for name, n in lengths.items() if name.endswith(NOT_SPLIT)):
        events = events.repartition("jobid", "timestamp")
    return materialize(events)


def write_events_csv(df: DataFrame, path: str, fields) -> None:
    """Write events as headerless gzip CSV in trace format (NULL for nulls)."""
    cols = [
        (F.col(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields
    ]
    (
        df.select(*cols).write.mode("overwrite")
        .option("sep", ",").option("nullValue", "NULL").option("compression", "gzip")
        .csv(path)
    )


def write_task_events_csv(df: DataFrame, path: str) -> None:
    write_events_csv(df, path, TASK_EVENT_FIELDS)


def write_job_events_csv(df: DataFrame, path: str) -> None:
    write_events_csv(df, path, JOB_EVENT_FIELDS)
