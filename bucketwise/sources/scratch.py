"""Working tables in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="bucketwise-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_MADE: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the
    master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _local_dir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the working tables made so far. Call it when the results that read them are written."""
    _delete(spark, _MADE[::-1])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for made in paths:
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)
        _MADE.remove(made)


def session_settings(spark: SparkSession) -> None:
    """Let the planner broadcast small files only; whatever was shuffled is judged by the bytes of its rows.

    Files of sorted keys and numbers are packed to a hundredth and less of their rows, so 10 MB of a working table can
    be over a gigabyte in the driver. Stages over 8,000 bytes of bytecode, which the JVM interprets, are left to the
    generators of single expressions, whose methods it compiles.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256KB")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they are done; elsewhere these stay until the driver collects garbage.

    Only for writes that own their plan: rows that are fetched bit by bit still need the files when the action returns.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write once, read back: cuts lineage at a table that outlives lost executors.

    Used where several branches need the same expensive rows; readers prune columns and rows.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables_end(spark: SparkSession) -> Iterator[None]:
    """Working tables made inside are read inside only, and deleted at the end."""
    before = set(_MADE)
    try:
        yield
    finally:
        _delete(spark, [path for path in _MADE if path not in before])


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table of what ``make`` returns. The working tables that ``make`` writes are read by nothing else and go."""
    before = set(_MADE)
    rows = make()
    inner = [path for path in _MADE if path not in before]
    out = materialize(rows, name)
    _delete(spark, inner)
    return out
