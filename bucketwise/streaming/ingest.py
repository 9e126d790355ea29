"""Incremental ingest with the batch upsert's result."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, types as T

from bucketwise.operators.keyed import first_per_key
from bucketwise.sources import versions
from bucketwise.sources.scratch import shuffles_end


def ingest_stream(
    source: DataFrame, table: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame],
    keys: Sequence = (), order: Sequence = (), compact_every: int | None = None,
) -> None:
    """Drain the source once: each micro-batch is judged row by row, written and published under its own batch id.

    ``judge`` keeps every row with its key, its order columns and its reject reason, and compares no two rows, so
    the stored rows do not depend on how the input was cut into batches. A replayed batch that is part of the table
    already changes nothing. After ``compact_every`` batches that are not compacted yet the table is compacted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number, manifest = versions.current(spark, table)
        if batch_id <= manifest.get("upto", -1) or str(batch_id) in manifest.get("batches", {}):
            return
        rows, folder = judge(batch), f"batch-{batch_id}-{uuid4().hex}"
        with shuffles_end(spark):
            rows.write.option("compression", "zstd").parquet(f"{table}/{folder}")
        batches = manifest.get("batches", {}) | {str(batch_id): folder}
        versions.publish(spark, table, number, manifest | {"schema": rows.schema.json(), "batches": batches})
        if compact_every and len(batches) >= compact_every:
            compact(spark, table, keys, order)

    query = (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def folders(spark: SparkSession, table: str) -> list[str]:
    """What a reader opens: the compacted part, if any, and the batches after it."""
    _, manifest = versions.current(spark, table)
    newer = [manifest["batches"][k] for k in sorted(manifest.get("batches", {}), key=int)]
    return [manifest["compacted"], *newer] if "compacted" in manifest else newer


def read_judged(spark: SparkSession, table: str) -> DataFrame:
    """The judged rows of an ingested table; the batch rule is applied to them as to one batch."""
    _, manifest = versions.current(spark, table)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    return versions.read_folders(spark, table, folders(spark, table), schema)


def compact(spark: SparkSession, table: str, keys: Sequence, order: Sequence) -> None:
    """Publish the first row per key, in the batch rule's order, in place of all batches so far.

    Reject reasons and order columns stay, so that rows of later batches still meet the row that decided. Folders of
    older versions stay for readers that opened them.
    """
    number, manifest = versions.current(spark, table)
    if not manifest.get("batches"):
        return
    folder = f"compacted-{uuid4().hex}"
    with shuffles_end(spark):
        first_per_key(read_judged(spark, table), keys, order).write.option("compression", "zstd").parquet(f"{table}/{folder}")
    upto = max(map(int, manifest["batches"]))
    versions.publish(spark, table, number, manifest | {"compacted": folder, "upto": upto, "batches": {}})
