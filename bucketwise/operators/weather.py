"""Local series, hourly features and weather attach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bucketwise import constants as C
from bucketwise.functions import times as T
from bucketwise.operators.keyed import first_per_key


def localize_series(
    rows: DataFrame,
    *,
    series: Sequence[str],
    wall: str,
    position: Sequence[str],
    zone: str,
    offset_seconds: Column,
) -> DataFrame:
    """Adds occurrence, local_kind and valid_time (null = dropped) to wall times of a series.

    The window holds the repeats of one wall time inside one series document.
    """
    w = Window.partitionBy(*series, wall).orderBy(*position)
    ranked = rows.withColumn("occurrence", F.row_number().over(w) - 1).withColumn("_zone", T.checked_zone(F.col(zone)))
    return ranked.withColumns(
        {
            "local_kind": T.local_kind(F.col(wall), F.col("_zone")),
            "valid_time": T.local_to_utc(F.col(wall), F.col("_zone"), offset_seconds, F.col("occurrence")),
        }
    ).drop("_zone")


def daily_maximum(hours: DataFrame, keys: Sequence[str], valid_time: str, value: str) -> DataFrame:
    """(keys, value_c, valid_times): maximum and every hour that reaches it.

    Works from the per-value minimum set: hours are grouped by (keys, value) only for the winning
    value, found by a map-side combined maximum. A local day has at most 25 distinct hours.
    """
    present = hours.filter(F.col(value).isNotNull())
    top = present.groupBy(*keys).agg(F.max(value).alias("value_c"))
    return (
        present.join(top, list(keys))
        .filter(F.col(value) == F.col("value_c"))
        .groupBy(*keys, "value_c")
        .agg(F.array_sort(F.collect_set(valid_time)).alias("valid_times"))
    )


def hourly_means(hours: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Null-ignoring means; wind direction is averaged like any other number."""
    return hours.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])


def hourly_states(hours: DataFrame, keys: Sequence[str], valid_time: str,
                  features: Sequence[str]) -> DataFrame:
    """(keys, forecast_hourly): the day's hourly structs sorted by time (at most 25 per local day)."""
    return hours.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(valid_time, *features))).alias("forecast_hourly")
    )


def hourly_features(
    hours: DataFrame, keys: Sequence[str], valid_time: str, means: Sequence[str], states: Sequence[str]
) -> DataFrame:
    """:func:`hourly_means` and :func:`hourly_states` in one pass over the hours."""
    state = F.struct(valid_time, *states)
    return hours.groupBy(*keys).agg(
        *[F.avg(f).alias(f) for f in means], F.array_sort(F.collect_list(state)).alias("forecast_hourly")
    )


def run_features(
    hours: DataFrame, *, station: str, run: str, date: str, valid_time: str, temperature: str, features: Sequence[str]
) -> DataFrame:
    """One row per station, run and local date: maximum, its hours, means and hourly states of that run alone.

    Runs are never mixed, so a decision that joins on the run it chose sees nothing of later ones, and the hourly
    array holds one run's local day.
    """
    keys = [station, run, date]
    tops = daily_maximum(hours, keys, valid_time, temperature)
    daily = hourly_features(hours, keys, valid_time, features, [temperature, *features])
    return daily.join(tops, keys, "left").select(
        *keys, F.col("value_c").alias("forecast_daily_max_c"), "valid_times", *features, "forecast_hourly",
        F.lit(True).alias("has_weather"), F.when(F.col("value_c").isNull(), "NO_USABLE_EVENT_COVERAGE").alias("reject"),
    )


def attach_weather(markets: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one weather row per key; a rejected key rejects all of its markets.

    ``keys`` name the run too, so that features come from the run the decision chose.
    """
    return markets.join(weather, list(keys), "left").withColumn(
        "weather_reject",
        F.coalesce(F.col("reject"), F.when(F.col("has_weather").isNull(), "no weather for station and date")),
    ).drop("reject", "has_weather")


def attach_archive(markets: DataFrame, archive: DataFrame, *, station: str, date: str,
                   order: Sequence[str]) -> DataFrame:
    """Adds the first archived maximum of the day; a missing archive is null, not a rejection."""
    first = first_per_key(archive, ["station_id", "local_date"], order).select(
        F.col("station_id").alias(station), F.col("local_date").alias(date),
        F.col("temperature_celsius").alias("diagnostic_actual_max_c"),
    )
    return markets.join(first, [station, date], "left")
