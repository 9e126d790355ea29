"""Point-in-time joins, clocks and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.functions import times as T
from bucketwise.operators import asof
from bucketwise.plans.bindings import (
    DUCK, SPARK, STATION_CODE, decisions, hourly, hourly_sql, price_sql, prices, snapshot_sql,
    snapshots, table, zone_case,
)
from bucketwise.plans.registry import query, rounded
from bucketwise.sources import stations as S

B1, B2, B4 = snapshot_sql(), price_sql(), hourly_sql()
ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def _iso(x: str) -> str:
    return ISO.format(x=x)


def _iso_s(col: str, name: str | None = None):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss").alias(name or col)


@query(
    "asof_price",
    f"""WITH {B2}, pts AS (SELECT token_id, observed_at, arg_min(price, price_seq) AS price FROM b2p
      WHERE price BETWEEN 0 AND 1 GROUP BY ALL)
    SELECT d.event_id, d.token_id, CASE WHEN d.decision_ts - p.observed_at <= INTERVAL 7 DAY
        THEN strftime(p.observed_at, '%Y-%m-%dT%H:%M:%S.%f') END AS observed_at,
      CASE WHEN d.decision_ts - p.observed_at <= INTERVAL 7 DAY THEN round(p.price, 6) END AS price
    FROM b2d d ASOF LEFT JOIN pts p ON d.token_id = p.token_id AND d.decision_ts >= p.observed_at""",
)
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.asof_price(
        decisions(spark, sf_dir), prices(spark, sf_dir), by=["token_id"], decision_ts="decision_ts",
        observed_at="observed_at", price="price", first_seen=["price_seq"],
    )
    return rounded(
        out.select(
            "event_id", "token_id",
            F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("observed_at"), "price",
        )
    )


@query(
    "latest_price",
    f"""WITH {B2} SELECT token_id, strftime(max(observed_at), '%Y-%m-%dT%H:%M:%S.%f') AS observed_at,
    round(arg_max(price, (observed_at, -price_seq)), 6) AS price FROM b2p WHERE price BETWEEN 0 AND 1 GROUP BY 1""",
)
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = prices(spark, sf_dir).filter("price BETWEEN 0 AND 1")
    out = asof.latest_per_key(valid, ["token_id"], "observed_at", ["price"], ["price_seq"])
    return rounded(
        out.select(
            "token_id", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("observed_at"),
            "price",
        )
    )


@query(
    "asof_run",
    f"""WITH {B2}, e AS (SELECT event_id, ts, date_trunc('day', ts) + INTERVAL 2 DAY - INTERVAL 1 SECOND AS day_end,
        time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS snapped FROM events),
      c AS (SELECT event_id, max(snapped - to_hours(cast(6 * k AS int))) AS issued FROM e, range(40) AS r(k)
        WHERE snapped - to_hours(cast(6 * k AS int)) + INTERVAL 6 HOUR <= ts
          AND snapped - to_hours(cast(6 * k AS int)) <= day_end
          AND day_end <= snapped - to_hours(cast(6 * k AS int)) + INTERVAL 240 HOUR GROUP BY 1)
    SELECT event_id, {_iso('issued')} AS issued_at, {_iso('issued + INTERVAL 6 HOUR')} AS available_at,
      strftime(issued, '%Y-%m-%dT%H:%M') AS run_param, issued IS NOT NULL AS covers_event_local_day
    FROM e LEFT JOIN c USING (event_id)""",
)
def asof_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    end = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", "ts")) + 2 * 86400 - 1)
    run = e.select("event_id", T.forecast_run(F.col("ts"), end).alias("issued"))
    return run.select(
        "event_id", _iso_s("issued", "issued_at"),
        F.date_format(T.available_at(F.col("issued")), "yyyy-MM-dd'T'HH:mm:ss").alias("available_at"),
        F.date_format("issued", "yyyy-MM-dd'T'HH:mm").alias("run_param"),
        F.col("issued").isNotNull().alias("covers_event_local_day"),
    )


@query(
    "lookahead_guard",
    f"""WITH {B1} SELECT token_id, raw_weight, CASE
      WHEN weather_issued_at > decision_ts THEN 'weather issued_at is after decision_ts'
      WHEN weather_available_at > decision_ts THEN 'weather available_at is after decision_ts; run not yet public'
      WHEN weather_available_at < weather_issued_at THEN 'weather available_at precedes issued_at'
      WHEN market_price_observed_at > decision_ts THEN 'price observed_at is after decision_ts'
      WHEN observation_as_of > decision_ts THEN 'observation_as_of is after decision_ts'
      WHEN observation_max_so_far_c IS NOT NULL AND observation_as_of IS NULL
        THEN 'observation_max_so_far_c requires observation_as_of <= decision_ts' END AS reason FROM b1""",
)
def lookahead_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir)
    return rows.select("token_id", "raw_weight", asof.lookahead_reason().alias("reason"))


def fold_zero(wall: str, zone: str) -> str:
    """SQL: UTC instant of a wall time, first reading when the wall time is repeated."""
    step = f"(CASE WHEN {zone} = 'Australia/Lord_Howe' THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 HOUR END)"
    at = f"({wall} AT TIME ZONE {zone})"
    return (
        f"(CASE WHEN (({at} - {step}) AT TIME ZONE {zone}) = {wall} THEN {at} - {step} ELSE {at} END)"
    )


@query(
    "decision_times",
    f"""WITH {B1}, z AS (SELECT token_id, raw_weight, {zone_case('n_nationkey')} AS zone, event_date,
      cast(event_date AS timestamp) - to_hours(cast(coalesce(forecast_lead_hours, 24) AS int)) AS wall FROM b1)
    SELECT token_id, raw_weight, event_date, {_iso(fold_zero('wall', 'zone') + " AT TIME ZONE 'UTC'")} AS decision_ts,
      cast(epoch(cast(event_date AS timestamp)) AS bigint) AS day_start,
      cast(epoch(cast(event_date AS timestamp)) AS bigint) + 86399 AS day_end FROM z""",
)
def decision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir)
    zone = F.expr(zone_case("n_nationkey"))
    lead = F.coalesce("forecast_lead_hours", F.lit(24.0))
    at = T.decision_instant(F.col("event_date"), zone, lead)
    return rows.select(
        "token_id", "raw_weight", "event_date",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("decision_ts"),
        T.day_start_epoch(F.col("event_date")).alias("day_start"),
        T.day_end_epoch(F.col("event_date")).alias("day_end"),
    )


@query(
    "day_bounds",
    """SELECT o_orderkey, cast(epoch(o_orderdate) AS bigint) AS start_epoch,
    cast(epoch(o_orderdate) AS bigint) + 86399 AS end_epoch, strftime(o_orderdate, '%Y-%m') AS event_month,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
      WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders""",
)
def day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.day_start_epoch(day).alias("start_epoch"), T.day_end_epoch(day).alias("end_epoch"),
        T.event_month(day).alias("event_month"), T.season(day).alias("season"),
    )


# series of wall times that cross spring gaps and autumn folds; some hours come two or three times
SHIFT_DAYS = "CASE station_no % 4 WHEN 0 THEN 64 WHEN 1 THEN 275 WHEN 2 THEN 70 ELSE 280 END"


@query(
    "local_series_to_utc",
    f"""WITH {B4}, s AS (SELECT station_no, {zone_case('station_no')} AS zone,
        hour + to_days({SHIFT_DAYS}) AS wall, c AS occurrence
        FROM b4, range(3) AS r(c) WHERE c <= station_no % 3),
      u AS (SELECT *, {fold_zero('wall', 'zone')} AS first_utc,
        CASE WHEN zone = 'Australia/Lord_Howe' THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 HOUR END AS step FROM s),
      k AS (SELECT *, CASE WHEN (first_utc AT TIME ZONE zone) <> wall THEN 'gap'
        WHEN ((first_utc + step) AT TIME ZONE zone) = wall THEN 'ambiguous' ELSE 'unambiguous' END AS kind FROM u)
    SELECT station_no, {_iso('wall')} AS wall, occurrence, kind,
      {_iso("(CASE WHEN kind = 'gap' THEN NULL WHEN occurrence = 0 THEN first_utc WHEN occurrence = 1 AND kind = 'ambiguous' THEN first_utc + step END) AT TIME ZONE 'UTC'")} AS utc
    FROM k""",
)
def local_series_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.operators.weather import localize_series

    base = hourly(spark, sf_dir).select(
        "station_no", F.expr(zone_case("station_no")).alias("zone"),
        F.expr(f"timestampadd(DAY, {SHIFT_DAYS}, hour)").alias("wall"),
        F.explode(F.sequence(F.lit(0), (F.col("station_no") % 3).cast("int"))).alias("pos"),
    )
    out = localize_series(
        base, series=["station_no"], wall="wall", position=["pos"], zone="zone",
        offset_seconds=F.lit(0),
    )
    return out.select(
        "station_no", _iso_s("wall"), F.col("occurrence").cast("bigint").alias("occurrence"),
        F.col("local_kind").alias("kind"), _iso_s("valid_time", "utc"),
    )


# ---- stations ---------------------------------------------------------------------------------------

NATION_CODE = STATION_CODE.format(n=SPARK.text("n_nationkey"))
NATION_CODE_SQL = STATION_CODE.format(n=DUCK.text("n_nationkey"))


def station_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension from the nations; every seventh nation is not a known station."""
    raw = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 3").select(
        F.expr(NATION_CODE).alias("station_id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.expr(NATION_CODE)).alias("icao"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit(" ")).otherwise(F.lit("XX")).alias("iata"),
        F.lower("n_name").alias("city"), F.expr(zone_case("n_nationkey")).alias("timezone_name"),
    )
    return S.with_defaults(raw)


STATION_SQL = f"""st AS (SELECT {NATION_CODE_SQL} AS station_id, n_name AS name, {NATION_CODE_SQL} AS icao,
    CASE WHEN n_nationkey % 3 <> 0 THEN 'XX' END AS iata, lower(n_name) AS city,
    {zone_case('n_nationkey')} AS timezone_name FROM nation WHERE n_nationkey % 7 <> 3)"""


@query("station_dimension", f"WITH {STATION_SQL} SELECT * FROM st")
def station_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_dim(spark, sf_dir)


@query(
    "station_join",
    f"""WITH {B1}, {STATION_SQL}, r AS (SELECT token_id, raw_weight,
      CASE WHEN length(slug) % 13 = 0 THEN ' ' ELSE upper(station_icao) END AS code FROM b1)
    SELECT token_id, raw_weight, station_id, timezone_name, CASE
      WHEN trim(code) = '' THEN 'station ICAO missing; unknown station quarantined'
      WHEN station_id IS NULL THEN 'unknown station ' || code || '; not remapped (e.g. LFPB is not LFPG)' END
      AS station_reason FROM r LEFT JOIN st ON st.station_id = r.code""",
)
def station_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).select(
        "token_id", "raw_weight",
        F.when(F.length("slug") % 13 == 0, F.lit(" "))
        .otherwise(F.concat(F.lower("station_icao"), F.lit(" "))).alias("code"),
    )
    return S.resolve_stations(rows, station_dim(spark, sf_dir), "code").select(
        "token_id", "raw_weight", "station_id", "timezone_name", "station_reason"
    )


@query(
    "required_ids",
    f"""WITH {STATION_SQL}, want AS (SELECT {NATION_CODE_SQL} AS id FROM nation UNION ALL
      SELECT unnest(['LFPG', 'EGLC', 'EDDM', 'EHAM', 'KJFK', 'LIMC', 'KLGA']))
    SELECT 'station' AS kind, id AS value FROM want WHERE id NOT IN (SELECT station_id FROM st)
    UNION ALL SELECT 'city', lower(trim(n_name)) FROM nation
      WHERE lower(trim(n_name)) NOT IN ('amsterdam', 'london', 'milan', 'munich', 'new york', 'paris')""",
)
def required_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    dim = station_dim(spark, sf_dir)
    _subset, unknown = S.select_stations(
        dim, nation.select(F.lower(F.expr(NATION_CODE)).alias("station_id"))
    )
    absent = unknown.unionByName(S.missing_stations(spark, dim))
    cities = S.validate_cities(nation, "n_name").filter("NOT supported")
    return absent.select(F.lit("station").alias("kind"), F.col("station_id").alias("value")).unionByName(
        cities.select(F.lit("city").alias("kind"), F.col("city_key").alias("value"))
    )
