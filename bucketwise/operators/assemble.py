"""Snapshot assembly: projection of the joined inputs, with the lookahead guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bucketwise.operators.asof import lookahead_reason
from bucketwise.sources.schemas import INSTANTS, NUMBERS, TEXT_LISTS, TEXTS

# fixed values: price history never proves an executable quote
NEVER_EXECUTABLE = (
    "executable_entry_price", "best_bid", "best_ask", "midpoint", "spread", "volume", "liquidity",
)
# fixed values: limitation texts every snapshot carries
LIMITATIONS = (
    "CLOB GET /prices-history returns {t,p} only; p is descriptive market_probability. "
    "executable_entry_price/best_bid/best_ask/midpoint/spread remain null because official "
    "public APIs do not reconstruct historical order books.",
    "Open-Meteo Archive daily max is a diagnostic grid/reanalysis value, not the "
    "Wunderground station print used for settlement.",
    "Gamma resolved outcomePrices are settlement labels only and are not decision-time features.",
)


def _present(df: DataFrame, name: str, kind: str):
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def assemble_snapshots(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, rejected) from joined market, price and weather columns.

    Inputs a caller does not have become typed nulls; executable columns are always null; a weather
    rejection or a lookahead fault routes the row out with its reason.
    """
    extra = F.coalesce(F.col("limitations"), F.array()) if "limitations" in df.columns else F.array()
    weather_reject = F.col("weather_reject") if "weather_reject" in df.columns else F.lit(None)
    source = F.coalesce(
        _present(df, "source_station_icao", "string"), _present(df, "station_icao", "string")
    )
    hourly = F.col("forecast_hourly") if "forecast_hourly" in df.columns else F.lit(None)
    shaped = df.select(
        "condition_id", "token_id", "event_date", "decision_ts",
        *[_present(df, c, "string") for c in TEXTS if c != "source_station_icao"],
        source.alias("source_station_icao"),
        *[F.lit(None).cast("double").alias(c) if c in NEVER_EXECUTABLE else _present(df, c, "double")
          for c in NUMBERS],
        *[_present(df, c, "timestamp") for c in INSTANTS],
        *[F.coalesce(_present(df, c, "array<string>"), F.array().cast("array<string>")).alias(c)
          for c in TEXT_LISTS if c != "limitations"],
        F.concat(F.array(*[F.lit(t) for t in LIMITATIONS]), extra.cast("array<string>")).alias("limitations"),
        F.array_sort(hourly).alias("forecast_hourly") if "forecast_hourly" in df.columns
        else hourly.cast("array<struct<valid_time:timestamp>>").alias("forecast_hourly"),
        weather_reject.cast("string").alias("_weather"),
    )
    reason = F.coalesce(
        "_weather", F.concat(F.lit("lookahead rejected: "), lookahead_reason())
    )
    judged = shaped.withColumn("reject_reason", reason)
    return (
        judged.filter("reject_reason IS NULL").drop("reject_reason", "_weather"),
        judged.filter("reject_reason IS NOT NULL").drop("_weather"),
    )
