"""Station dimension: load with defaults, completeness check, lookup and subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise import constants as C
from bucketwise.functions.text import blank_to_null

STATION_DDL = (
    "station_id string, name string, icao string, iata string, city string, latitude double, "
    "longitude double, elevation_m double, timezone_name string, coordinate_source string"
)


def with_defaults(stations: DataFrame) -> DataFrame:
    """Blank optional texts become null and a missing code falls back to the station id."""
    return stations.withColumns(
        {
            "icao": F.coalesce(F.nullif(F.col("icao"), F.lit("")), F.col("station_id")),
            "iata": blank_to_null(F.col("iata")),
        }
    )


def missing_stations(
    spark: SparkSession, stations: DataFrame, required: Sequence[str] = C.REQUIRED_STATIONS
) -> DataFrame:
    """Required ids the dimension does not hold; an empty result means the dimension is complete."""
    want = spark.createDataFrame([(r,) for r in required], "station_id string")
    return want.join(stations.select("station_id"), "station_id", "left_anti")


def load_stations(
    spark: SparkSession, path: str, required: Sequence[str] = C.REQUIRED_STATIONS
) -> DataFrame:
    """JSON-lines station file to a typed dimension; raises when a required id is missing."""
    dim = with_defaults(spark.read.schema(STATION_DDL).json(path))
    absent = [r.station_id for r in missing_stations(spark, dim, required).collect()]
    if absent:
        raise ValueError(f"stations file missing required ids: {sorted(absent)}")
    return dim


def select_stations(stations: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subset, unknown ids) for a table of wanted ids in any letter case."""
    ids = wanted.select(F.upper("station_id").alias("_id")).distinct()
    known = stations.withColumn("_id", F.upper("station_id"))
    subset = known.join(ids, "_id", "left_semi").drop("_id")
    unknown = ids.join(known.select("_id"), "_id", "left_anti").select(F.col("_id").alias("station_id"))
    return subset, unknown


def resolve_stations(rows: DataFrame, stations: DataFrame, code: str) -> DataFrame:
    """Adds the station columns and ``station_reason``; codes are never remapped or guessed.

    The dimension is small, but its size is left to the optimizer's own broadcast threshold.
    """
    token = F.upper(F.trim(F.col(code)))
    dim = stations.select(F.upper("station_id").alias("_code"), *stations.columns)
    joined = rows.withColumn("_code", token).join(dim, "_code", "left")
    reason = F.when(
        F.col("_code").isNull() | (F.col("_code") == ""),
        "station ICAO missing; unknown station quarantined",
    ).when(
        F.col("station_id").isNull(),
        F.concat(
            F.lit("unknown station "), F.col("_code"), F.lit("; not remapped (e.g. LFPB is not LFPG)")
        ),
    )
    return joined.withColumn("station_reason", reason).drop("_code")


def validate_cities(cities: DataFrame, city: str) -> DataFrame:
    """Adds ``city_key`` (trimmed, lower) and ``supported``."""
    key = F.lower(F.trim(F.col(city)))
    return cities.withColumns({"city_key": key, "supported": key.isin(*C.TARGET_CITIES)})


