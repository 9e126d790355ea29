"""Snapshot and quarantine files: JSON lines, Parquet and JSON logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bucketwise.functions.identity import dedup_key
from bucketwise.functions.text import blank_to_null
from bucketwise.functions.times import iso_utc, parse_instant
from bucketwise.sources import schemas as S
from bucketwise.sources.scratch import materialize, shuffles_end, tables_end

#: an ordered write sorts so many key ranges in turn, with borders from about so many keys
RANGES = 3
BORDER_KEYS = 4000


def hourly_state(item: Column) -> Column:
    """Hourly struct from JSON text: an object, or a positional list padded to nine fields."""
    v = F.try_parse_json(item)

    def number(name: str, index: int) -> Column:
        by_name = F.try_variant_get(v, f"$.{name}", "string")
        by_place = F.try_variant_get(v, f"$[{index}]", "string")
        return F.coalesce(by_name, by_place).try_cast("double").alias(name)

    at = F.coalesce(
        F.try_variant_get(v, "$.valid_time_utc", "string"), F.try_variant_get(v, "$[0]", "string")
    )
    return F.struct(
        parse_instant(at).alias("valid_time_utc"),
        *[number(name, i + 1) for i, name in enumerate(S.HOURLY_FIELDS)],
    )


def decode_snapshots(raw: DataFrame) -> DataFrame:
    """Typed snapshots from text rows: blank is null, a missing list is empty, a missing flag false."""
    def texts(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)

    return raw.select(
        *S.REQUIRED,
        parse_instant(F.col("decision_ts")).alias("decision_ts"),
        *[blank_to_null(F.col(c)).alias(c) for c in S.TEXTS],
        *[F.nullif(F.col(c), F.lit("")).try_cast("double").alias(c) for c in S.NUMBERS],
        *[parse_instant(F.col(c)).alias(c) for c in S.INSTANTS],
        *[texts(c) for c in S.TEXT_LISTS],
        "canonical_event_key",
        F.transform(
            F.filter(F.coalesce("weather_valid_times", F.array()), lambda t: t != ""), parse_instant
        ).alias("weather_valid_times"),
        F.transform(F.coalesce("forecast_hourly", F.array()), hourly_state).alias("forecast_hourly"),
        F.coalesce("canonical_event_ambiguous", F.lit(False)).alias("canonical_event_ambiguous"),
    )


def read_snapshots_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return decode_snapshots(spark.read.schema(S.SNAPSHOT_JSON).json(path))


def read_snapshots_payload(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with one JSON ``payload`` column."""
    raw = spark.read.schema("payload string").parquet(path)
    return decode_snapshots(raw.select(F.from_json("payload", S.SNAPSHOT_JSON).alias("r")).select("r.*"))


def _with_iso(stamp: str):
    def encode(h: Column) -> Column:
        return h.withField(stamp, iso_utc(h[stamp]))

    return encode


def encode_snapshots(df: DataFrame) -> DataFrame:
    """JSON-ready rows: instants as ISO text, plus the dedup key."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp":
            out[f.name] = iso_utc(F.col(f.name))
        elif f.name == "weather_valid_times":
            out[f.name] = F.transform(f.name, iso_utc)
        elif f.name == "forecast_hourly":
            out[f.name] = F.transform(f.name, _with_iso(f.dataType.elementType.fields[0].name))
    return df.withColumns(
        {
            "dedup_key": dedup_key(
                F.col("condition_id"), F.col("token_id"), F.col("event_date"), F.col("decision_ts")
            )
        }
    ).withColumns(out)


def _snapshot_key() -> Column:
    return dedup_key(F.col("condition_id"), F.col("token_id"), F.col("event_date"), F.col("decision_ts"))


def _without_void(kind: T.DataType) -> T.DataType:
    """Files of typed rows have no column type for nothing but nulls."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_void(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_void(f.dataType), f.nullable) for f in kind.fields])
    return kind


def _held(df: DataFrame, *more: Column) -> DataFrame:
    """The rows as a table, so that the shuffles behind them are over before a file is written."""
    typed = [F.col(f.name).cast(_without_void(f.dataType)).alias(f.name) for f in df.schema.fields]
    return materialize(df.select(*typed, *more), "unordered")


def write_snapshots_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON object a line; field names and paths repeat in every row, so plain text is many times its content."""
    with tables_end(df.sparkSession):
        encode_snapshots(_held(df)).write.options(ignoreNullFields="false", compression=compression).json(path)


def _write_ordered(df: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame], **options: str) -> None:
    """Files ordered by dedup key inside, their ranges apart; ``shape`` is made of the rows (and ``_key``) in their place.

    The wide rows of one key range after the other are sorted, so no more than about one ``RANGES``-th of them lies in
    shuffle files. Borders are quantiles of some of the keys, as in Spark's own sort: they only decide how even the
    ranges are. The folder gets its name when it is complete.
    """
    spark, key = df.sparkSession, F.col("_key")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid4().hex}")
    system = final.getFileSystem(conf)
    if system.exists(final):
        raise FileExistsError(path)
    try:
        with tables_end(spark):
            rows = _held(df, _snapshot_key().alias("_key"))
            share = min(1.0, BORDER_KEYS / max(1, rows.count()))
            keys = sorted(r._key for r in rows.select(key).sample(fraction=share, seed=1).collect())
            inner = sorted({keys[len(keys) * i // RANGES] for i in range(1, RANGES)}) if keys else []
            for low, high in pairwise([None, *inner, None]):
                here = [c for c in (None if low is None else key >= low, None if high is None else key < high) if c is not None]
                part = reduce(Column.__and__, here, F.lit(True))
                with shuffles_end(spark):
                    shape(rows.filter(part).sort(key)).write.mode("append").options(**options).parquet(draft.toString())
        if system.exists(final) or not system.rename(draft, final):
            raise FileExistsError(path)
    except BaseException:
        system.delete(draft, True)
        raise


def write_snapshots_payload(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """One JSON payload per row ordered by dedup key, for readers of the single-column layout.

    The typed rows are ordered, and encoded when they lie in their place.
    """
    def payload(rows: DataFrame) -> DataFrame:
        return encode_snapshots(rows.drop("_key")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))

    _write_ordered(df, path, payload, compression=compression)


def write_snapshots(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Typed Parquet ordered by dedup key: readers prune columns and skip row groups."""
    _write_ordered(df, path, lambda rows: rows.withColumn("dedup_key", F.col("_key")).drop("_key"), compression=compression)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _existing(spark: SparkSession, path: str, read) -> DataFrame | None:
    """What ``read`` finds at ``path``; None where nothing was ever written."""
    try:
        return read(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rejects from JSON array files; elements that are not objects are skipped, a missing path holds none."""
    docs = _existing(spark, path, lambda p: spark.read.text(p, wholetext=True))
    return quarantine_from_documents(spark.createDataFrame([], "value string") if docs is None else docs)


def quarantine_from_documents(docs: DataFrame) -> DataFrame:
    """Rejects of JSON array documents in column ``value``."""
    items = F.coalesce(
        F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    rows = docs.select(F.explode(items).alias("v")).filter(
        F.schema_of_variant("v").startswith("OBJECT")
    )
    names = [f.split(" ")[0] for f in S.QUARANTINE.split(", ")]
    fields = rows.select(*[blank_to_null(F.try_variant_get("v", f"$.{n}", "string")).alias(n) for n in names])
    return fields.withColumn("reason", F.coalesce("reason", F.lit("unspecified")))


#: folders of the quarantine log; a reason is free text, so it is not a folder of its own
QUARANTINE_PARTS = 16


def _reason_part(reason: Column) -> Column:
    return (F.crc32(reason.cast("binary")) % QUARANTINE_PARTS).cast("int")


def write_quarantine(df: DataFrame, path: str) -> None:
    """Append rejects to the log, spread by a bounded code of their reason."""
    reason = F.coalesce(blank_to_null(F.col("reason")), F.lit("unspecified"))
    df.withColumn("reason", reason).withColumn("reason_part", _reason_part(F.col("reason"))).write.partitionBy(
        "reason_part"
    ).mode("append").parquet(path)


def read_quarantine_log(spark: SparkSession, path: str, reason: str | None = None) -> DataFrame:
    """Rejects of the log, of one reason (which reads one folder) or all; a missing log holds none."""
    rows = _existing(spark, path, lambda p: spark.read.parquet(p))
    if rows is None:
        return spark.createDataFrame([], S.QUARANTINE)
    if reason is not None:
        rows = rows.where(F.col("reason_part") == _reason_part(F.lit(reason))).where(F.col("reason") == reason)
    return rows.drop("reason_part")
