"""Session helpers.

The library never creates a session on its own inside operators; callers pass
one in. ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sojourn") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a shared, fault-tolerant file system): a folder of
    one machine would lose what other executors write, so there is no fallback.
    Only with a ``local`` master (tests) a fresh scratch folder is chosen.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sojourn-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SCOPE: ContextVar[list | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Paths that ``scratch_path`` gives inside the scope are removed at its end, also after an
    error. What is to outlive it is written by ``keep(df)``, which the scope gives: a frame that belongs to
    the scope around it, or to the application."""
    outer, paths = _SCOPE.get(), []
    token = _SCOPE.set(paths)

    def keep(df):
        inner = _SCOPE.set(outer)
        try:
            path = scratch_path(spark, "kept")
        finally:
            _SCOPE.reset(inner)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            fs = target.getFileSystem(conf)
            fs.delete(target, True)
            fs.cancelDeleteOnExit(target)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the checkpoint folder, removed at the end of the scope, else of the application."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)  # deleteOnExit only takes what exists
    fs.deleteOnExit(target)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def input_version(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of the files at ``path``: changes when they do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(conf).listStatus(target)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))
