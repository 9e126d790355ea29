"""Domain-shaped views of the star-schema test tables, for Spark and for the SQL check.

Each binding is a set of SQL expressions valid in both engines; a :class:`Dialect` supplies the few
functions whose names differ. Payload documents are cut by an id range, so no document (and no
array) can grow with a hot user or order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.operators.groups import with_event_key
from bucketwise.operators.keyed import first_per_key
from bucketwise.sources.scratch import materialize


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def iso_date(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')" if self.spark else f"strftime({x}, '%Y-%m-%d')"

    def iso_ts(self, x: str) -> str:
        """Second-precision ISO text."""
        if self.spark:
            return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\")"
        return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"

    def month(self, x: str) -> str:
        return f"date_format({x}, 'MMMM')" if self.spark else f"strftime({x}, '%B')"

    def add_hours(self, ts: str, n: str) -> str:
        if self.spark:
            return f"timestampadd(HOUR, cast({n} as int), {ts})"
        return f"({ts} + to_hours(cast({n} as int)))"

    def add_minutes(self, ts: str, n: str) -> str:
        if self.spark:
            return f"timestampadd(MINUTE, cast({n} as int), {ts})"
        return f"({ts} + to_minutes(cast({n} as int)))"

    def add_days(self, ts: str, n: str) -> str:
        if self.spark:
            return f"timestampadd(DAY, cast({n} as int), {ts})"
        return f"({ts} + to_days(cast({n} as int)))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def text(self, x: str) -> str:
        return f"cast({x} as string)" if self.spark else f"cast({x} as varchar)"

    def epoch(self, ts: str) -> str:
        return f"unix_seconds({ts})" if self.spark else f"cast(floor(epoch({ts})) as bigint)"

    def day(self, ts: str) -> str:
        return f"date_trunc('day', {ts})"

    def intdiv(self, a: str, b: int) -> str:
        return f"cast(floor(({a}) / {float(b)}) as bigint)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with naive stamps read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


# ---- snapshots (B1) ---------------------------------------------------------------------------

SEQ_COLUMNS = (
    "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate",
    "l_returnflag", "l_linestatus",
)
CITY_CASE = (
    "CASE n_nationkey % 6 WHEN 0 THEN 'paris' WHEN 1 THEN 'london' WHEN 2 THEN 'munich' "
    "WHEN 3 THEN 'amsterdam' WHEN 4 THEN 'new york' ELSE 'milan' END"
)
STATION_CODE = "'K' || translate(lpad({n}, 3, '0'), '0123456789', 'ABCDEFGHIJ')"
BOUNDS = {1: (None, 10), 2: (11, 17), 3: (18, 24), 4: (25, 25), 5: (26, 36), 6: (37, 45), 7: (46, None)}
KINDS = {1: "below", 2: "range", 3: "range", 4: "exact", 5: "range", 6: "range", 7: "above"}
LABELS = {1: "10{u} or below", 2: "11-17{u}", 3: "18-24{u}", 4: "25{u}", 5: "26-36{u}",
          6: "37-45{u}", 7: "46{u} or higher"}
SLUG_TAILS = {1: "-10c-or-below", 2: "-11-17c", 3: "-18-24c", 4: "-25c", 5: "-26-36c", 6: "-37-45c",
              7: "-or-higher"}


def _by_line(values: dict[int, object]) -> str:
    parts = []
    for line, v in values.items():
        shown = "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{float(v)}")
        parts.append(f"WHEN {line} THEN {shown}")
    return f"CASE l_linenumber {' '.join(parts)} END"


def snapshot_expressions(d: Dialect) -> dict[str, str]:
    key = "l_orderkey || '-' || l_linenumber"
    day = f"CASE WHEN l_partkey % 103 = 0 THEN {d.add_days('o_orderdate', '1')} ELSE o_orderdate END"
    unit = "CASE WHEN l_suppkey % 23 = 0 THEN 'F' ELSE 'C' END"
    city = f"CASE WHEN l_partkey % 97 = 0 THEN 'milan' ELSE {CITY_CASE} END"
    station = (
        "CASE WHEN l_partkey % 101 = 0 THEN 'KZZZ' ELSE "
        + STATION_CODE.format(n=d.text("n_nationkey")) + " END"
    )
    lo = _by_line({k: v[0] for k, v in BOUNDS.items()})
    hi = _by_line({k: v[1] for k, v in BOUNDS.items()})
    kind = _by_line(KINDS)
    native_lo = (
        f"CASE WHEN l_partkey % 139 = 0 THEN NULL WHEN l_partkey % 47 = 0 AND l_linenumber IN (2,3,5,6) "
        f"THEN ({lo}) + 1 ELSE {lo} END"
    )
    native_hi = (
        f"CASE WHEN l_partkey % 139 = 0 THEN NULL WHEN l_partkey % 43 = 0 AND l_linenumber IN (2,3,5,6) "
        f"THEN ({hi}) + 1 ELSE {hi} END"
    )
    label = (
        "CASE WHEN l_suppkey % 23 = 0 THEN "
        + _by_line({k: v.format(u="°F") for k, v in LABELS.items()})
        + " ELSE " + _by_line({k: v.format(u="°C") for k, v in LABELS.items()}) + " END"
    )
    decision = d.add_hours("o_orderdate", "-24")
    issued = d.add_hours(decision, "-(l_suppkey % 13 - 1)")
    date_words = f"{d.month('o_orderdate')} || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)"
    date_slug = (
        f"lower({d.month('o_orderdate')}) || '-' || day(o_orderdate) || '-' || year(o_orderdate)"
    )
    slug_city = f"CASE WHEN l_partkey % 37 = 0 THEN 'london' ELSE replace({CITY_CASE}, ' ', '-') END"
    return {
        "condition_id": f"'c' || {key}",
        "market_id": f"'m' || {key}",
        "token_id": f"'t' || {key}",
        "event_id": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'e' || l_orderkey END",
        "neg_risk_market_id": (
            "CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_partkey % 109 = 0 THEN 'nx' "
            "ELSE 'n' || l_orderkey END"
        ),
        "event_slug": (
            "CASE WHEN l_orderkey % 12 = 0 THEN NULL WHEN l_partkey % 107 = 0 THEN 'other-event' "
            "ELSE ' Event-Slug-' || l_orderkey END"
        ),
        "slug": (
            "CASE WHEN l_orderkey % 24 = 0 THEN NULL ELSE "
            f"'will-the-highest-temperature-in-' || {slug_city} || '-on-' || {date_slug} || "
            f"{_by_line(SLUG_TAILS)} END"
        ),
        "question": (
            "CASE WHEN l_orderkey % 48 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN 'Will it rain on ' || "
            f"{date_words} || '?' ELSE 'Will the highest temperature in ' || {CITY_CASE} || ' be ' || "
            f"{label} || ' on ' || {date_words} || '?' END"
        ),
        "city": city,
        "station_icao": station,
        "source_station_icao": f"CASE WHEN l_partkey % 113 = 0 THEN 'KYYY' ELSE {station} END",
        "event_date": d.iso_date(f"({day})"),
        "decision_ts": decision,
        "bucket_label": f"CASE WHEN l_partkey % 127 = 0 THEN '' ELSE {label} END",
        "bucket_kind": f"CASE WHEN l_partkey % 131 = 0 THEN 'unknown' ELSE {kind} END",
        "temperature_unit": unit,
        "temperature_native_min": native_lo,
        "temperature_native_max": native_hi,
        "temperature_celsius_min": (
            f"CASE WHEN l_suppkey % 23 = 0 THEN (({lo}) - 32.0E0) * 5.0E0 / 9.0E0 ELSE {lo} END"
        ),
        "temperature_celsius_max": (
            f"CASE WHEN l_suppkey % 23 = 0 THEN (({hi}) - 32.0E0) * 5.0E0 / 9.0E0 ELSE {hi} END"
        ),
        "market_probability": (
            "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE (l_quantity - 1.0E0) / 100.0E0 END"
        ),
        "settlement_label": (
            "CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END"
        ),
        "forecast_daily_max_c": (
            "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE cast(p_size as double) END"
        ),
        "diagnostic_actual_max_c": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_quantity END",
        "forecast_lead_hours": (
            "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE cast(l_partkey % 60 as double) END"
        ),
        "best_ask": (
            "CASE WHEN l_partkey % 31 = 0 AND l_partkey % 29 <> 0 "
            "THEN (l_quantity - 1.0E0) / 100.0E0 + 0.02E0 END"
        ),
        "executable_entry_price": "cast(NULL as double)",
        "weather_issued_at": issued,
        "weather_available_at": (
            f"CASE WHEN l_suppkey % 31 = 0 THEN {d.add_hours(issued, '-1')} "
            f"ELSE {d.add_hours(issued, '6')} END"
        ),
        "market_price_observed_at": d.add_minutes(decision, "-(l_partkey % 100 - 2)"),
        "observation_max_so_far_c": (
            "CASE WHEN l_linenumber = 7 THEN l_discount * 100 END"
        ),
        "observation_as_of": (
            f"CASE WHEN l_partkey % 5 = 0 THEN {d.add_hours(decision, '(l_suppkey % 3 - 1)')} END"
        ),
        "dew_point_c": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax * 100 END",
        "humidity_pct": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount * 100 END",
        "cloud_cover_pct": "cast(l_linenumber * 10 as double)",
        "wind_speed": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_quantity / 10 END",
        "precipitation": "l_tax",
        "surface_pressure": "1000 + l_discount",
        "provenance_urls": d.array(
            "'https://api.example.com/markets/' || l_orderkey",
            "'https://www.Wunderground.com/history/daily/us/city/' || " + station + " || '.'",
        ),
        "raw_paths": d.array("'raw/' || l_orderkey || '.json'"),
        "content_hashes": d.array("'h' || l_partkey"),
    }


SNAPSHOT_FROM = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"
)


@lru_cache(maxsize=8)
def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with what a snapshot is shaped from.

    Orders get their nation and lines their part before the two meet, so a line is shuffled once for each of its two keys.
    """
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "part")}
    orders = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )


def _shaped(lines: DataFrame) -> DataFrame:
    exprs = [F.expr(sql).alias(name) for name, sql in snapshot_expressions(SPARK).items()]
    return lines.select(
        *exprs, F.struct(*SEQ_COLUMNS).alias("seq"), F.col("l_extendedprice").alias("raw_weight"),
        F.col("o_orderdate").alias("order_ts"), F.col("n_nationkey"),
    )


@lru_cache(maxsize=8)
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, shaped as a research snapshot; copies included."""
    return _shaped(snapshot_lines(spark, sf_dir))


@lru_cache(maxsize=8)
def snapshots_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen snapshot per dedup key, with its event key.

    The lines are deduplicated by their keys before the texts are made, so no wide row is shuffled or sorted for it.
    """
    made = snapshot_expressions(SPARK)
    keys = [F.expr(made[k]) for k in ("condition_id", "token_id", "event_date", "decision_ts")]
    return with_event_key(_shaped(first_per_key(snapshot_lines(spark, sf_dir), keys, SEQ_COLUMNS)))


SCORED_COLUMNS = (
    "event_key", "condition_id", "token_id", "event_date", "city", "station_icao", "bucket_label",
    "bucket_kind", "settlement_label", "market_probability", "forecast_lead_hours", "best_ask",
    "raw_weight",
)


def snapshots_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique snapshots with a model probability independent of the models: share of the event's
    weight."""
    # totals and rows both need the deduplicated snapshots, so they are written once
    rows = materialize(snapshots_unique(spark, sf_dir).select(*SCORED_COLUMNS), "scored")
    totals = rows.groupBy("event_key").agg(F.sum("raw_weight").alias("_total"))
    return rows.join(totals, "event_key").withColumn(
        "model_p", F.col("raw_weight") / F.col("_total")
    ).drop("_total")


def _select(exprs: dict[str, str]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in exprs.items())


SQL_KEY = """CASE
    WHEN event_id <> '' THEN 'event_id' || chr(1) || event_id
    WHEN neg_risk_market_id <> '' THEN 'neg_risk_market_id' || chr(1) || neg_risk_market_id
    WHEN event_slug <> '' THEN 'event_slug' || chr(1) || lower(trim(event_slug))
    WHEN slug_family IS NOT NULL THEN 'slug_family' || chr(1) || slug_family
    WHEN question_family IS NOT NULL AND city <> '' AND station_icao <> '' AND event_date <> ''
      THEN 'question_family' || chr(1) || question_family || chr(1) || city || chr(1) || station_icao
        || chr(1) || event_date
    ELSE 'ambiguous' || chr(1) || condition_id || chr(1) || token_id END"""

SQL_SLUG_FAMILY = (
    "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(slug)), "
    "'-([0-9]+(-[0-9]+)?[cf]|or-below|or-higher|or-lower|or-above)$', ''), '^will-the-', ''), "
    "'-be-[^-]+-on-', '-on-', 'g'), '')"
)
SQL_QUESTION_CLEAN = (
    "regexp_replace(regexp_replace(question, '\\bbe\\s+(between\\s+)?[^?]+\\s+on\\s+', 'on ', 'gi'), "
    "'\\bbe\\s+[^?]+\\s+on\\s+', 'on ', 'gi')"
)
SQL_FAMILY_PATTERN = (
    "'(?i)(highest\\s+temperature\\s+in\\s+.+?\\s+on\\s+[A-Za-z]+\\s+[0-9]{1,2}(?:,\\s*[0-9]{4})?)'"
)
SQL_QUESTION_FAMILY = (
    "nullif(regexp_replace(lower(trim(coalesce("
    f"nullif(regexp_extract({SQL_QUESTION_CLEAN}, {SQL_FAMILY_PATTERN}, 1), ''), "
    f"nullif(regexp_extract(question, {SQL_FAMILY_PATTERN}, 1), '')"
    "))), '\\s+', ' ', 'g'), '')"
)


def snapshot_sql() -> str:
    """CTEs b1 (all rows), b1k (with families and event_key), b1u (first seen), b1m (model_p)."""
    seq = ", ".join(SEQ_COLUMNS)
    return f"""b1 AS (
  SELECT {_select(snapshot_expressions(DUCK))},
  {seq}, l_extendedprice AS raw_weight, o_orderdate AS order_ts, n_nationkey
  FROM {SNAPSHOT_FROM}),
b1f AS (SELECT *, {SQL_SLUG_FAMILY} AS slug_family, {SQL_QUESTION_FAMILY} AS question_family FROM b1),
b1k AS (SELECT *, {SQL_KEY} AS event_key,
    condition_id || '|' || token_id || '|' || event_date || '|'
      || strftime(decision_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS dedup_key FROM b1f),
b1r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {seq}) AS rn FROM b1k),
b1u AS (SELECT * FROM b1r WHERE rn = 1),
b1m AS (SELECT *, raw_weight / sum(raw_weight) OVER (PARTITION BY event_key) AS model_p FROM b1u)"""


# ---- prices and decisions (B2) -----------------------------------------------------------------

def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click', 'error')")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("token_id"), F.col("ts").alias("observed_at"),
        (F.col("value") / 500.0).alias("price"), F.col("event_id").alias("price_seq"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'signup')")
    return e.select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("token_id"), F.col("ts").alias("decision_ts"),
    )


def price_sql() -> str:
    return """b2p AS (SELECT 'u' || user_id AS token_id, ts AS observed_at, value / 500.0 AS price,
    event_id AS price_seq FROM events WHERE event_type IN ('view', 'click', 'error')),
b2d AS (SELECT event_id, 'u' || user_id AS token_id, ts AS decision_ts FROM events
    WHERE event_type IN ('purchase', 'signup'))"""


# ---- price-history payloads (B3) ----------------------------------------------------------------
# one document per (user, 1000 consecutive event ids): at most 1000 items by construction

PRICE_DOC = 1000


@lru_cache(maxsize=8)
def price_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, kind, payload): JSON documents, one seventh of the users each kind of fault."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "user_id", F.expr(SPARK.intdiv("event_id", PRICE_DOC)).alias("doc"), "event_id",
        F.unix_seconds("ts").alias("t"), "value",
    )
    kind = F.col("user_id") % 7
    item = F.struct(
        F.col("event_id").alias("i"),
        F.to_json(
            F.struct(
                F.col("t").alias("t"),
                F.when(kind != 1, F.when(kind == 4, F.lit(1.5)).otherwise(F.round(F.col("value") / 500.0, 6)))
                .alias("p"),
            )
        ).alias("j"),
    )
    docs = rows.groupBy("user_id", "doc").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    inner = F.array_join(F.transform("items", lambda x: x["j"]), ",")
    kind = F.col("user_id") % 7
    payload = (
        F.when(kind == 2, F.lit('{"error":"rate limited"}'))
        .when(kind == 3, F.lit('{"history":[]}'))
        .when(
            kind == 5,
            F.concat(F.lit('{"history":[{"t":true,"p":0.5},'), inner, F.lit("]}")),
        )
        .when((kind == 6) & (F.col("user_id") % 2 == 0), F.concat(F.lit("["), inner, F.lit("]")))
        .otherwise(F.concat(F.lit('{"history":['), inner, F.lit("]}")))
    )
    return docs.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("doc").cast("string")).alias("payload_id"),
        F.concat(F.lit("u"), "user_id").alias("token_id"),
        payload.alias("payload"),
    )


def price_payload_sql() -> str:
    return f"""b3i AS (SELECT user_id, {DUCK.intdiv('event_id', PRICE_DOC)} AS doc, event_id,
    cast(floor(epoch(ts)) as bigint) AS t,
    CASE WHEN user_id % 7 = 1 THEN NULL WHEN user_id % 7 = 4 THEN 1.5 ELSE round(value / 500.0, 6) END AS p
  FROM events)"""


# ---- hourly weather (B4) --------------------------------------------------------------------------

WEATHER_ZONES = ("Europe/Paris", "America/New_York", "Australia/Lord_Howe", "UTC", "Asia/Kolkata")


def zone_case(n: str) -> str:
    parts = " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(WEATHER_ZONES))
    return f"CASE {n} % {len(WEATHER_ZONES)} {parts} END"


@lru_cache(maxsize=8)
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_no, run_day, hour, features): one row per station and hour."""
    e = table(spark, sf_dir, "events")
    return (
        e.groupBy(F.col("user_id").alias("station_no"), F.date_trunc("hour", "ts").alias("hour"))
        .agg(
            F.max("value").alias("top"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"),
        )
        .select(
            "station_no", F.date_trunc("day", "hour").alias("run_day"), "hour",
            F.when(F.col("n") % 5 != 4, F.col("top") / 10).alias("temperature_c"),
            (F.col("low") / 20).alias("dew_point_c"),
            F.when(F.col("station_no") % 3 != 0, F.col("low")).alias("humidity_pct"),
            F.col("n").cast("double").alias("wind_speed"),
        )
    )


def hourly_sql() -> str:
    return """b4 AS (SELECT station_no, date_trunc('day', hour) AS run_day, hour,
    CASE WHEN n % 5 <> 4 THEN top / 10 END AS temperature_c,
    low / 20 AS dew_point_c,
    CASE WHEN station_no % 3 <> 0 THEN low END AS humidity_pct,
    cast(n AS double) AS wind_speed
  FROM (SELECT user_id AS station_no, date_trunc('hour', ts) AS hour, max(value) AS top,
          min(value) AS low, count(*) AS n FROM events GROUP BY ALL))"""


@lru_cache(maxsize=8)
def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, zone, run_day, payload): parallel-array documents of at most 24 hours."""
    rows = hourly(spark, sf_dir)
    item = F.struct("hour", "temperature_c", "dew_point_c", "humidity_pct", "wind_speed")
    docs = rows.groupBy("station_no", "run_day").agg(F.array_sort(F.collect_list(item)).alias("h"))

    def series(name: str):
        return F.transform("h", lambda x: x[name])

    payload = F.to_json(
        F.struct(
            F.expr(zone_case("station_no")).alias("timezone"),
            F.lit(0).alias("utc_offset_seconds"),
            F.struct(
                F.when(F.col("station_no") % 11 == 0, F.lit("°F")).otherwise(F.lit("°C")).alias("temperature_2m"),
                F.lit("°C").alias("dew_point_2m"),
                F.lit("%").alias("relative_humidity_2m"),
                F.lit("km/h").alias("wind_speed_10m"),
                F.lit("K").alias("temperature_2m_member01"),
            ).alias("hourly_units"),
            F.struct(
                F.transform("h", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                series("temperature_c").alias("temperature_2m"),
                series("dew_point_c").alias("dew_point_2m"),
                series("humidity_pct").alias("relative_humidity_2m"),
                series("wind_speed").alias("wind_speed_10m"),
                F.transform("h", lambda x: x["temperature_c"] + 273.15).alias("temperature_2m_member01"),
            ).alias("hourly"),
            F.struct(F.lit("°C").alias("temperature_2m_max")).alias("daily_units"),
            F.struct(
                F.array(F.date_format("run_day", "yyyy-MM-dd")).alias("time"),
                F.array(F.array_max(series("temperature_c"))).alias("temperature_2m_max"),
            ).alias("daily"),
        ),
        {"ignoreNullFields": "false"},
    )
    return docs.select(
        F.concat(F.lit("S"), "station_no").alias("station_id"),
        F.expr(zone_case("station_no")).alias("zone"),
        "station_no", "run_day", payload.alias("payload"),
    )


# ---- market text (B5) ---------------------------------------------------------------------------------

MARKET_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
# markets per search document: order keys are unique, so a document has at most this many
SEARCH_DOC = 8


def market_expressions(d: Dialect) -> dict[str, str]:
    """Raw market record per order with ten kinds of textual trouble."""
    k = "o_orderkey % 10"
    deg = "cast(o_custkey % 35 as int)"
    long_date = f"{d.month('o_orderdate')} || ' ' || day(o_orderdate)"
    slug_day = f"(CASE WHEN {k} = 2 THEN {d.add_days('o_orderdate', '1')} ELSE o_orderdate END)"
    slug_date = f"lower({d.month(slug_day)}) || '-' || day({slug_day}) || '-' || year({slug_day})"
    topic = f"{k} = 3"
    title = (
        f"CASE o_orderkey % 7 WHEN 0 THEN {deg} || '°C' WHEN 1 THEN {deg} || '-' || ({deg} + 1) || '°F' "
        f"WHEN 2 THEN {deg} || '°C or below' WHEN 3 THEN ' ' || {deg} || ' °C or higher' "
        f"WHEN 4 THEN '-' || {deg} WHEN 5 THEN 'warm' ELSE ({deg} + 2) || '–' || {deg} || ' Celsius' END"
    )
    station = STATION_CODE.format(n=d.text("n_nationkey"))
    return {
        "id": "'m' || o_orderkey",
        "condition_id": "CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE '0x' || o_orderkey END",
        "question": (
            f"CASE WHEN {topic} THEN 'Will it rain in ' || {CITY_CASE} || ' on ' || {long_date} || '?' "
            f"ELSE 'Will the highest temperature in ' || {CITY_CASE} || ' be ' || {deg} || '°C on ' || "
            f"{long_date} || CASE WHEN {k} IN (0, 5) THEN '' ELSE ', ' || year(o_orderdate) END || '?' END"
        ),
        "slug": (
            f"CASE WHEN {k} = 8 THEN NULL WHEN {topic} THEN 'rain-' || o_orderkey ELSE "
            f"'highest-temperature-in-' || replace({CITY_CASE}, ' ', '-') || '-on-' || "
            f"CASE WHEN {k} IN (0, 5) THEN lower({d.month('o_orderdate')}) || '-' || day(o_orderdate) "
            f"ELSE {slug_date} END END"
        ),
        "description": (
            f"CASE WHEN {k} = 4 THEN 'Resolves on ' || {d.month('o_orderdate')} || ' 28, 2031.' "
            f"WHEN {k} = 5 THEN 'Resolves for ' || day(o_orderdate) || ' ' || substr({d.month('o_orderdate')}, 1, 3) "
            f"|| ' ''' || substr({d.text('year(o_orderdate)')}, 3, 2) || ' at Station (' || {station} || ').' "
            f"WHEN {k} = 6 THEN 'Either (' || {station} || ') or (KQQQ) decides.' "
            f"WHEN {k} = 9 THEN NULL "
            f"ELSE 'Source https://www.wunderground.com/history/daily/us/x/' || {station} || ' applies' END"
        ),
        "event_day": f"CASE WHEN {k} = 1 THEN {d.iso_date('o_orderdate')} END",
        "title": title,
        "closed": "CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'P' THEN false END",
        "resolved": "CASE WHEN o_orderkey % 5 = 0 THEN true END",
        "outcomes": (
            "CASE WHEN o_orderkey % 13 = 0 THEN '[\"Yes\"]' WHEN o_orderkey % 13 = 1 THEN '[\"Up\",\"Down\"]' "
            "WHEN o_orderkey % 13 = 2 THEN 'broken' ELSE '[\"Yes\",\"No\"]' END"
        ),
        "tokens": (
            "CASE WHEN o_orderkey % 17 = 0 THEN '[\"a' || o_orderkey || '\"]' "
            "ELSE '[\"a' || o_orderkey || '\",\"b' || o_orderkey || '\"]' END"
        ),
        "outcome_prices": (
            "CASE o_orderkey % 6 WHEN 0 THEN '[\"1\",\"0\"]' WHEN 1 THEN '[\"0\",\"1\"]' WHEN 2 THEN '[\"0.4\",\"0.6\"]' "
            "WHEN 3 THEN '[\"1\",\"0\",\"0\"]' WHEN 4 THEN '[\"0.0000000001\",\"1\"]' ELSE '[\"x\",\"1\"]' END"
        ),
        "start_text": f"{d.iso_ts('o_orderdate')} || CASE WHEN {k} = 1 THEN '' ELSE 'Z' END",
        "end_text": d.text(d.epoch("o_orderdate")) + " || CASE WHEN o_orderkey % 2 = 0 THEN '000' ELSE '' END",
        "event_ref": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'ev' || " + d.intdiv("o_orderkey", 4) + " END",
    }


@lru_cache(maxsize=8)
def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    exprs = [F.expr(sql).alias(n) for n, sql in market_expressions(SPARK).items()]
    return joined.select("o_orderkey", "n_nationkey", *exprs)


def market_sql() -> str:
    return f"b5 AS (SELECT o_orderkey, n_nationkey, {_select(market_expressions(DUCK))} FROM {MARKET_FROM})"


def market_json() -> "F.Column":
    return F.struct(
        F.col("id").alias("id"),
        F.col("condition_id").alias("conditionId"),
        F.col("question"), F.col("slug"), F.col("description"),
        F.col("title").alias("groupItemTitle"),
        F.col("outcomes"), F.col("tokens").alias("clobTokenIds"),
        F.col("outcome_prices").alias("outcomePrices"),
        F.col("closed"), F.col("resolved"),
        F.col("start_text").alias("startDate"), F.col("end_text").alias("endDate"),
        F.col("event_day").alias("eventDate"), F.col("event_ref").alias("eventId"),
    )


@lru_cache(maxsize=8)
def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, payload): nested search documents of eight orders; two events plus direct
    markets, of which one repeats a nested market. Some documents are faulty."""
    m = markets(spark, sf_dir)
    doc = F.expr(SPARK.intdiv("o_orderkey", SEARCH_DOC))
    packed = (
        m.select(doc.alias("payload_id"), F.struct("o_orderkey", market_json().alias("m")).alias("r"))
        .groupBy("payload_id")
        .agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(
            a["o_orderkey"] < b["o_orderkey"], -1).when(a["o_orderkey"] > b["o_orderkey"], 1).otherwise(0)
        ).alias("rs"))
    )

    def nested(parity: int):
        return F.transform(
            F.filter("rs", lambda r: (r["o_orderkey"] % 4) == parity), lambda r: r["m"]
        )

    def event(parity: int):
        return F.struct(
            F.concat(F.lit(f"e{parity}-"), F.col("payload_id").cast("string")).alias("id"),
            F.concat(F.lit(f"slug-{parity}-"), F.col("payload_id").cast("string")).alias("slug"),
            F.when(F.lit(parity == 0), F.concat(F.lit("neg-"), F.col("payload_id").cast("string")))
            .alias("negRiskMarketID"),
            nested(parity).alias("markets"),
        )

    direct = F.transform(
        F.filter("rs", lambda r: (r["o_orderkey"] % 4 >= 2) | (r["o_orderkey"] % 8 == 0)), lambda r: r["m"]
    )
    good = F.to_json(
        F.struct(F.array(event(0), event(1)).alias("events"), direct.alias("markets"))
    )
    kind = F.col("payload_id") % 20
    payload = (
        F.when(kind == 1, F.lit('{"error":"nope"}'))
        .when(kind == 2, F.lit('{"unexpected":true}'))
        .when(kind == 3, F.lit('{"events":[],"markets":[]}'))
        .when(kind == 4, F.lit('{"events":"x"}'))
        .when(kind == 5, F.lit('{"events":[{"id":"","markets":[]}]}'))
        .when(kind == 6, F.lit('{"events":[],"markets":[{"question":"only"}]}'))
        .when(kind == 7, F.lit('{"events":[],"markets":[{"conditionId":"0x1","question":"Will it rain?"}]}'))
        .otherwise(good)
    )
    return packed.select("payload_id", payload.alias("payload"))
