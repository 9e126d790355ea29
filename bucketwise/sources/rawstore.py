"""Content-addressed raw payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.functions.identity import canonical_url
from bucketwise.operators.keyed import upsert


def payload_digest(payload: Column) -> Column:
    """SHA-256 of the canonical JSON (sorted keys, no blanks); text that is not JSON as it is."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(payload)), payload), 256)


def raw_path(source: Column, url: Column, digest: Column) -> Column:
    name = F.sha2(F.concat(url, F.lit("\n"), digest), 256)
    folder = F.replace(F.replace(source, F.lit(".."), F.lit("")), F.lit("/"), F.lit("_"))
    return F.concat_ws("/", folder, F.substring(name, 1, 2), F.concat(name, F.lit(".json")))


def address_payloads(rows: DataFrame, *, source: str, url: str, payload: str) -> DataFrame:
    """Adds request_url, content_sha256 and raw_path."""
    return rows.withColumn("request_url", canonical_url(F.col(url))).withColumn(
        "content_sha256", payload_digest(F.col(payload))
    ).withColumn("raw_path", raw_path(F.col(source), F.col("request_url"), F.col("content_sha256")))


def record_payloads(base: DataFrame, delta: DataFrame, version: list[str]) -> DataFrame:
    """Same URL and content reuse their row; changed content adds one."""
    return upsert(base, delta, ["content_sha256", "request_url"], version)


def new_payloads(delta: DataFrame, stored: DataFrame) -> DataFrame:
    """Payloads whose address is not stored yet."""
    return delta.join(stored.select("raw_path"), "raw_path", "left_anti")


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


#: columns of the store; ``shard`` is the first two digits of the address
STORED = "raw_path string, request_url string, content_sha256 string, payload string, shard string"


def store_payloads(spark: SparkSession, addressed: DataFrame, store: str) -> DataFrame:
    """Append the documents whose address the store does not hold, once each; returns what the store holds then.

    Documents lie in 256 folders by the first digits of their address, many to a file, so a store of billions of
    documents stays readable. Writing the same documents again adds nothing.
    """
    rows = addressed.select(
        "raw_path", "request_url", "content_sha256", "payload", F.regexp_extract("raw_path", r"([0-9a-f]{2})/[^/]*$", 1).alias("shard")
    ).dropDuplicates(["raw_path"])
    held = _stored(spark, store)
    fresh = rows if held is None else new_payloads(rows, held)
    fresh.write.mode("append").partitionBy("shard").parquet(store)
    return spark.read.schema(STORED).parquet(store)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(raw_path, payload, v): one JSON document per file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("raw_path"), F.col("value").alias("payload"),
        F.try_parse_json("value").alias("v"),
    )
