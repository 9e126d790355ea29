"""Declared schemas; nothing is inferred."""

from __future__ import annotations

HOURLY_STRUCT = (
    "struct<valid_time_utc:timestamp, temperature_c:double, dew_point_c:double, humidity_pct:double, "
    "cloud_cover_pct:double, wind_speed:double, wind_direction_deg:double, precipitation:double, "
    "surface_pressure:double>"
)
HOURLY_FIELDS = (
    "temperature_c", "dew_point_c", "humidity_pct", "cloud_cover_pct", "wind_speed",
    "wind_direction_deg", "precipitation", "surface_pressure",
)

TEXTS = (
    "market_id", "city", "station_icao", "bucket_label", "bucket_kind", "settlement_label", "event_id",
    "question", "group_item_title", "slug", "event_slug", "neg_risk_market_id", "temperature_unit",
    "source_station_icao", "price_request_url", "price_raw_path", "price_content_sha256",
    "canonical_event_source", "canonical_event_quarantine_reason",
)
NUMBERS = (
    "temperature_celsius_min", "temperature_celsius_max", "market_probability",
    "executable_entry_price", "best_bid", "best_ask", "midpoint", "spread", "volume", "liquidity",
    "forecast_daily_max_c", "observation_max_so_far_c", "diagnostic_actual_max_c",
    "temperature_native_min", "temperature_native_max", "dew_point_c", "humidity_pct",
    "cloud_cover_pct", "wind_speed", "wind_direction_deg", "precipitation", "surface_pressure",
    "forecast_lead_hours",
)
INSTANTS = (
    "weather_issued_at", "weather_available_at", "observation_as_of", "market_price_observed_at",
)
TEXT_LISTS = (
    "provenance_urls", "raw_paths", "content_hashes", "limitations", "canonical_event_evidence",
)
REQUIRED = ("condition_id", "token_id", "event_date")

# JSON lines carry texts; decoding applies the null rules
SNAPSHOT_JSON = ", ".join(
    [f"{c} string" for c in (*REQUIRED, "decision_ts", *TEXTS, *NUMBERS, *INSTANTS)]
    + [f"{c} array<string>" for c in (*TEXT_LISTS, "canonical_event_key", "weather_valid_times")]
    + ["forecast_hourly array<string>", "canonical_event_ambiguous boolean", "dedup_key string"]
)
QUARANTINE = (
    "reason string, condition_id string, market_id string, token_id string, city string, "
    "station_icao string, event_date string, details string"
)
