"""Keyed tables in hash buckets, merged by rewriting only the buckets that a delta touches.

A row's bucket is a hash of its key, so a delta meets exactly those stored rows that can share a key with it: the other
buckets are neither read nor written, and their files stay. New buckets go into a folder of their own and become part
of the table when its next manifest is published (:mod:`bucketwise.sources.versions`); a merge that fails changes nothing
and can be run again, and the same delta merged twice gives the same rows.

Null key parts count as equal empty values, as in :func:`bucketwise.operators.keyed.upsert`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bucketwise.operators.keyed import first_per_key
from bucketwise.sources import versions
from bucketwise.sources.scratch import materialize

BUCKETS = 256


def _parts(keys: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*_parts(keys)), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """Numbers of the buckets that rows fall into, at most all of them."""
    return sorted(r[0] for r in rows.select(_bucket(keys, buckets)).distinct().collect())


def _write(rows: DataFrame, table: str, keys: Sequence[str], buckets: int) -> str:
    folder = f"rows-{uuid4().hex}"
    rows.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{table}/{folder}")
    return folder


def _folders(manifest: dict, wanted: Sequence[int] | None = None) -> list[str]:
    held = manifest["buckets"]
    return [held[k] for k in (map(str, wanted) if wanted is not None else sorted(held)) if k in held]


def create(rows: DataFrame, table: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new table of unique rows, or an empty one."""
    spark = rows.sparkSession
    used = _touched(rows, keys, buckets)
    folder = _write(rows, table, keys, buckets) if used else ""
    held = {str(b): f"{folder}/_bucket={b}" for b in used}
    versions.publish(spark, table, 0, {"n": buckets, "keys": list(keys), "schema": rows.schema.json(), "buckets": held})


def read(spark: SparkSession, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The newest version, or some of its buckets."""
    _, manifest = versions.current(spark, table)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    return versions.read_folders(spark, table, _folders(manifest, buckets), schema)


def replace(spark: SparkSession, table: str, rows: DataFrame, touched: Sequence[int]) -> None:
    """Publish ``rows`` as the whole content of the ``touched`` buckets."""
    number, manifest = versions.current(spark, table)
    if not touched:
        return
    folder = _write(rows, table, manifest["keys"], manifest["n"])
    # a bucket that lost its last row has no folder
    left = set(_touched(versions.read_folders(spark, table, [folder], rows.schema), manifest["keys"], manifest["n"]))
    held = {k: v for k, v in manifest["buckets"].items() if int(k) not in set(touched)}
    held |= {str(b): f"{folder}/_bucket={b}" for b in left}
    versions.publish(spark, table, number, manifest | {"buckets": held})


def upsert_into(table: str, delta: DataFrame, version: Sequence[str]) -> None:
    """Merge a delta: the last write of every key, by ``version``, wins for all columns."""
    spark = delta.sparkSession
    _, manifest = versions.current(spark, table)
    keys = manifest["keys"]
    delta = materialize(delta, "delta")
    touched = _touched(delta, keys, manifest["n"])
    stored = read(spark, table, touched)
    bag = stored.unionByName(delta.select(*stored.columns))
    replace(spark, table, first_per_key(bag, _parts(keys), [F.col(c).desc() for c in version]), touched)


def upsert_parents_into(
    parents: str, children: str, delta: DataFrame, delta_children: DataFrame, *, id_col: str, version: Sequence[str]
) -> None:
    """Merge parents by natural key, and with each winning write its children.

    A key keeps the id it was first given. Stored parents are one row per key; stored children carry the parent's id.
    ``delta_children`` carry the id and version of the write they belong to. Of the children's buckets only those of
    parents that changed are rewritten. The parents are published last: a run that dies between the two is repaired by
    merging the delta again.
    """
    spark = delta.sparkSession
    _, manifest = versions.current(spark, parents)
    _, below = versions.current(spark, children)
    keys = manifest["keys"]
    delta = materialize(delta, "delta")
    touched = _touched(delta, keys, manifest["n"])
    stored = read(spark, parents, touched)
    names = [f"_k{i}" for i in range(len(keys))]
    bag = (
        stored.withColumn("_new", F.lit(0)).unionByName(delta.select(*stored.columns).withColumn("_new", F.lit(1)))
        .select("*", *[c.alias(n) for n, c in zip(names, _parts(keys), strict=True)])
    )
    ids = bag.groupBy(*names).agg(F.min_by(id_col, F.struct("_new", *version, id_col)).alias("_id"))
    last = first_per_key(bag, names, [*[F.col(c).desc() for c in version], F.col("_new").desc(), F.col(id_col).desc()])
    winners = materialize(last.join(ids, names).drop(*names), "winners")

    changed = winners.where("_new = 1").select(F.col("_id"), F.col(id_col), *version)
    rows = materialize(
        delta_children.join(changed, [id_col, *version]).withColumn(id_col, F.col("_id")).drop("_id", *version), "children"
    )
    buckets = sorted({*_touched(changed.select(F.col("_id").alias(id_col)), [id_col], below["n"])})
    kept = read(spark, children, buckets).join(changed.select(F.col("_id").alias(id_col)), id_col, "left_anti")
    replace(spark, children, kept.unionByName(rows.select(*kept.columns)), buckets)
    replace(spark, parents, winners.withColumn(id_col, F.col("_id")).select(*stored.columns), touched)
