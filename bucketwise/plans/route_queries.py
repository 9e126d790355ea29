"""The whole routing chain, from discovered market to outcome, and the report of a collection run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.operators import router as R
from bucketwise.plans import text_queries as T
from bucketwise.plans.bindings import STATION_CODE, table
from bucketwise.plans.payload_queries import search_verdicts
from bucketwise.plans.registry import SQL, query, rounded

RANGE = ("1993-01-01", "1997-12-31")
LOOKAHEAD = "lookahead rejected: "
# what the weather of a (station, day) came to, by the least order of its customers' nation and day
WEATHER_CLASSES = {
    0: (R.SINGLE_RUN_SCHEMA, "forecast schema: hourly missing"), 1: (R.ARCHIVE_SCHEMA, "archive schema: daily missing"),
    2: (R.SINGLE_RUN_COVERAGE, "NO_USABLE_EVENT_COVERAGE; provider=single-run"),
    3: (R.ARCHIVE_COVERAGE, "NO_USABLE_EVENT_COVERAGE; provider=archive"),
}


PRICE_STATUS = "CASE o_orderkey % 8 WHEN 5 THEN 'http_error' WHEN 6 THEN 'schema_error' WHEN 7 THEN 'empty' END"


def _weather_case(field: int) -> str:
    return "CASE h % 9 " + " ".join(f"WHEN {k} THEN '{v[field]}'" for k, v in WEATHER_CLASSES.items()) + " END"


CHAIN_SQL = f"""{T.ROUTE_SQL},
wx AS (SELECT station_id, event_date, h, {_weather_case(0)} AS class, {_weather_case(1)} AS reject, cast(event_date AS timestamp) AS decision_ts,
    cast(event_date AS timestamp) + CASE WHEN h % 9 = 4 THEN INTERVAL 1 HOUR ELSE INTERVAL '-12' HOUR END AS issued_at,
    cast(event_date AS timestamp) + CASE h % 9 WHEN 5 THEN INTERVAL 1 HOUR WHEN 6 THEN INTERVAL '-13' HOUR ELSE INTERVAL '-6' HOUR END AS available_at
  FROM (SELECT {STATION_CODE.format(n='cast(c_nationkey AS varchar)')} AS station_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date, min(o_orderkey) AS h
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
px AS (SELECT 'a' || l_orderkey AS token_id, cast(l_shipdate AS timestamp) - INTERVAL 30 DAY AS seen_at, l_discount * 5 AS price, l_linenumber FROM lineitem),
yo AS (SELECT rt.o_orderkey, rt.condition_id, rt.reason AS market_reason, mk.station_icao AS station_id, mk.event_date, mk.event_ref, mk.slug,
    mk.question, mk.city, unnest(CASE WHEN rt.reason IS NOT NULL THEN [cast(NULL AS varchar)]
      ELSE list_filter(list_transform(range(len(st.ls)), lambda i: CASE WHEN lower(st.ls[i + 1]) = 'yes' THEN coalesce(({T._list('st.tokens')})[i + 1],
        concat_ws(':', rt.condition_id, i)) END), lambda x: x IS NOT NULL) END) AS token_id
  FROM rt JOIN mk USING (o_orderkey) JOIN st USING (o_orderkey)),
yw AS (SELECT yo.*, wx.* EXCLUDE (station_id, event_date), CASE WHEN wx.h IS NULL THEN 'NO_USABLE_EVENT_COVERAGE' ELSE wx.reject END AS weather_reject
  FROM yo LEFT JOIN wx ON market_reason IS NULL AND wx.station_id = yo.station_id AND wx.event_date = yo.event_date),
yp AS (SELECT yw.*, (SELECT arg_max(price, {{'a': seen_at, 'l': -l_linenumber}}) FROM px WHERE px.token_id = yw.token_id AND px.seen_at <= yw.decision_ts
    AND px.seen_at >= yw.decision_ts - INTERVAL 7 DAY) AS price FROM yw),
ch AS (SELECT *, CASE WHEN market_reason IS NOT NULL THEN market_reason WHEN weather_reject IS NOT NULL THEN weather_reject
    WHEN coalesce(event_ref, '') = '' AND coalesce(trim(slug), '') = '' AND NOT regexp_matches(question,
      'highest[ ]+temperature[ ]+in[ ]+.+?[ ]+on[ ]+[A-Za-z]+[ ]+[0-9]{{1,2}}', 'i') THEN 'event_identity_ambiguous'
    WHEN issued_at > decision_ts THEN '{LOOKAHEAD}weather issued_at is after decision_ts'
    WHEN available_at > decision_ts THEN '{LOOKAHEAD}weather available_at is after decision_ts; run not yet public'
    WHEN available_at < issued_at THEN '{LOOKAHEAD}weather available_at precedes issued_at' END AS reason,
    CASE WHEN market_reason IS NULL AND weather_reject IS NULL THEN {PRICE_STATUS} END AS price_status FROM yp)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    markets = T.placed_markets(spark, sf_dir)
    reason = R.market_reason(known_station=F.col("station_id").isNotNull())
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    decision = F.to_timestamp("event_date")
    weather = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.expr(STATION_CODE.format(n="cast(c_nationkey as string)")).alias("station_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"))
        .agg(F.min("o_orderkey").alias("h"))
        .select(
            "station_id", "event_date", F.expr(_weather_case(0)).alias("weather_class"), F.expr(_weather_case(1)).alias("weather_reject"),
            decision.alias("decision_ts"),
            (decision + F.expr("CASE WHEN h % 9 = 4 THEN INTERVAL 1 HOUR ELSE INTERVAL -12 HOUR END")).alias("weather_issued_at"),
            (decision + F.expr("CASE h % 9 WHEN 5 THEN INTERVAL 1 HOUR WHEN 6 THEN INTERVAL -13 HOUR ELSE INTERVAL -6 HOUR END")).alias("weather_available_at"),
        )
    )
    lines = table(spark, sf_dir, "lineitem")
    token = F.concat(F.lit("a"), "l_orderkey")
    prices = lines.select(token.alias("token_id"), (F.col("l_shipdate") - F.expr("INTERVAL 30 DAY")).cast("timestamp").alias("observed_at"), (F.col("l_discount") * 5).alias("price"), "l_linenumber")
    verdicts = orders.select(F.concat(F.lit("a"), "o_orderkey").alias("token_id"), F.expr(PRICE_STATUS).alias("price_status"))
    rows = markets.withColumn("reason", reason).withColumns({
        "observation_as_of": F.lit(None).cast("timestamp"), "observation_max_so_far_c": F.lit(None).cast("double"),
    })
    return R.route_outcomes(rows, weather, prices, verdicts, first_seen=["l_linenumber"])


@query("route_outcomes", f"WITH {CHAIN_SQL} SELECT condition_id, token_id, reason, round(CASE WHEN weather_reject IS NULL THEN price END, 6) AS price, price_status FROM ch")
def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _chain(spark, sf_dir)
    return rounded(rows.select("condition_id", "token_id", "reason", F.col("market_probability").alias("price"), "price_status"))


@query(
    "collection_counters",
    f"""WITH {CHAIN_SQL}, pairs AS (SELECT DISTINCT station_id, event_date, class FROM ch WHERE market_reason IS NULL)
    SELECT (SELECT count(DISTINCT condition_id) FROM ch WHERE event_date IS NULL OR event_date BETWEEN '{RANGE[0]}' AND '{RANGE[1]}') AS markets_seen,
    (SELECT count(*) FROM ch WHERE reason IS NULL) AS snapshots_written, (SELECT count(*) FROM ch WHERE reason IS NOT NULL) AS quarantined,
    (SELECT count(*) FROM mk WHERE event_date NOT BETWEEN '{RANGE[0]}' AND '{RANGE[1]}') AS discovered_outside_range,
    """ + ",\n    ".join(f"(SELECT count(*) FROM ch WHERE price_status = '{s}') AS {n}" for s, n in R.PRICE_ERRORS.items())
    + f""", (SELECT count(*) FROM ({SQL['search_payload_verdicts']}) WHERE status <> 'ok') AS gamma_schema_errors,
    """ + ",\n    ".join(f"(SELECT count(*) FROM ch WHERE class = '{c}') AS {c}" for c in (R.SINGLE_RUN_SCHEMA, R.ARCHIVE_SCHEMA))
    + ",\n    " + ",\n    ".join(f"(SELECT count(*) FROM pairs WHERE class = '{c}') AS {c}" for c in (R.SINGLE_RUN_COVERAGE, R.ARCHIVE_COVERAGE)),
)
def collection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a collection run: twelve counters, most taken while the routed rows are written."""
    rows, counters = _chain(spark, sf_dir)
    found = T.placed_markets(spark, sf_dir)
    route = R.date_route(F.col("event_date"), *RANGE)
    discovered = found.agg(
        F.count_distinct(F.when(route != "outside", F.col("condition_id"))).alias("markets_seen"),
        F.count_if(route == "outside").alias("discovered_outside_range"),
    )
    broken = search_verdicts(spark, sf_dir).agg(F.count_if(F.col("status") != "ok").alias("gamma_schema_errors"))
    return discovered.join(broken).select("*", *[F.lit(v).cast("long").alias(k) for k, v in counters.items()])  # one row each
