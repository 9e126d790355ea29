"""Tables as sets of immutable folders, named by a numbered manifest.

A writer puts its rows into new folders and then publishes a manifest that names the folders of the new version. The
manifest is written under another name and renamed to its number, which the file system does at once and refuses if that
number exists: readers see the old version or the new one, a writer that died leaves folders that nothing names, and
of two writers that started from the same version one fails. All paths go through Spark's file systems. On stores without
an atomic rename let one writer at a time publish.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, types as T

_DIGITS = 12


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, table: str) -> tuple[int, dict]:
    """(number, manifest) of the newest version; number 0 and an empty manifest before the first."""
    folder, system = _path(spark, f"{table}/_versions")
    if not system.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    numbers = [int(n[:_DIGITS]) for n in names if n.endswith(".json") and n[:_DIGITS].isdigit()]
    if not numbers:
        return 0, {}
    last = max(numbers)
    text = spark.read.text(f"{table}/_versions/{last:0{_DIGITS}d}.json", wholetext=True).first()[0]
    return last, json.loads(text)


def publish(spark: SparkSession, table: str, after: int, manifest: dict) -> None:
    """Make ``manifest`` the version behind number ``after``; raises FileExistsError if another writer was first."""
    draft, system = _path(spark, f"{table}/_versions/.{uuid4().hex}")
    final, _ = _path(spark, f"{table}/_versions/{after + 1:0{_DIGITS}d}.json")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        stream.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise FileExistsError(f"{table}: version {after + 1} was published by another writer")


def read_folders(spark: SparkSession, table: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """The rows of some folders of a table."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/{f}" for f in folders])
