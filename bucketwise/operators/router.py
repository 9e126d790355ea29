"""First-failing-check routing of discovered markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from bucketwise import constants as C
from bucketwise.functions import text as X
from bucketwise.functions.identity import with_identity
from bucketwise.operators.asof import asof_price, lookahead_reason
from bucketwise.sources.scratch import materialize


def date_route(event_date: Column, start: str, end: str) -> Column:
    """Dated rows are in range or outside; undated rows pass through to quarantine."""
    return F.when(event_date.isNull(), "undated").when(event_date.between(start, end), "in_range").otherwise(
        "outside"
    )


def market_reason(known_station: Column) -> Column:
    """Reason of the first failing check of a normalised market, null when it is accepted.

    Expects market columns plus resolved, outcomes, outcomePrices and groupItemTitle.
    """
    settled = X.settlement_label(
        F.col("closed"), F.col("resolved"), F.col("outcomes"), F.col("outcomePrices")
    )["reason"]
    station = F.col("station_icao")
    labels = F.transform(X.json_list(F.col("outcomes")), F.lower)
    bucket = X.temperature_bucket(X.blank_to_null(F.col("groupItemTitle")))
    return (
        F.when(~X.is_topic_text(F.col("question"), F.col("slug")), "not a temperature market")
        .when(F.col("event_date").isNull(), "unknown/ambiguous event date")
        .when(settled.isNotNull(), settled)
        .when(station.isNull() | (F.trim(station) == ""), "station ICAO missing; unknown station quarantined")
        .when(
            ~known_station,
            F.concat(
                F.lit("unknown station "), F.upper(F.trim(station)),
                F.lit("; not remapped (e.g. LFPB is not LFPG)"),
            ),
        )
        .when(~F.array_contains(labels, "yes"), "YES token missing")
        .when(bucket.isNull(), "unknown/ambiguous temperature bucket")
    )


def outcome_reason() -> Column:
    """The checks after the market's own, per outcome row: weather, identity, lookahead; the first that fails.

    Expects weather_reject, identity and the snapshot's stamps. Put behind :func:`market_reason` by coalesce.
    """
    return (
        F.when(F.col("weather_reject").isNotNull(), F.col("weather_reject"))
        .when(F.col("identity.ambiguous"), F.col("identity.quarantine_reason"))
        .when(lookahead_reason().isNotNull(), F.concat(F.lit("lookahead rejected: "), lookahead_reason()))
    )


#: what a rejected weather pair is counted as
SINGLE_RUN_SCHEMA, ARCHIVE_SCHEMA = "single_run_schema_errors", "archive_schema_errors"
SINGLE_RUN_COVERAGE, ARCHIVE_COVERAGE = "single_run_no_usable_event_coverage", "archive_no_usable_event_coverage"
PRICE_ERRORS = {"http_error": "price_http_errors", "schema_error": "price_schema_errors", "empty": "price_history_empty"}


def yes_outcomes(markets: DataFrame) -> DataFrame:
    """One row per rejected market (null token) and one per YES outcome of the others.

    ``markets``: normalised columns, the raw outcomes, clobTokenIds and groupItemTitle, and ``reason``. The reason
    is carried over the one-to-many step; a blank bucket is an outcome's own reason.
    """
    labels, tokens = X.json_list(F.col("outcomes")), X.json_list(F.col("clobTokenIds"))
    rejected = F.col("reason").isNotNull()
    paired = F.transform(labels, lambda x, i: F.struct(x.alias("label"), i.alias("at")))
    chosen = F.when(rejected, F.array(F.lit(None).cast("struct<label:string,at:int>"))).otherwise(
        F.filter(paired, lambda o: F.lower(o["label"]) == "yes")
    )
    rows = markets.withColumn("_outcome", F.explode(chosen)).withColumn(
        "bucket", X.temperature_bucket(X.blank_to_null(F.col("groupItemTitle")))
    )
    at = F.col("_outcome.at")
    token = F.coalesce(F.get(tokens, at), F.concat_ws(":", "condition_id", at.cast("string")))
    return rows.withColumns({
        "token_id": F.when(~rejected, token),
        "reason": F.coalesce("reason", F.when(F.col("bucket").isNull(), "unknown/ambiguous temperature bucket")),
    }).drop("_outcome")


def route_outcomes(
    markets: DataFrame, weather: DataFrame, prices: DataFrame, price_verdicts: DataFrame, first_seen: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, int]]:
    """(rows with the first failing reason of the whole chain, counters taken while they were written).

    ``markets`` as in :func:`yes_outcomes` with station_id; ``weather``: station_id, event_date, weather_class,
    weather_reject and the stamps and features of the chosen run, one row per pair; ``prices``: token_id, observed_at,
    price; ``price_verdicts``: token_id, price_status. A market's reason stands before weather, identity and
    lookahead. Weather is asked once per (station, day), prices only for outcomes whose weather stands.
    """
    pair = ["station_id", "event_date"]
    outcomes = materialize(yes_outcomes(markets), "outcomes")
    asking = outcomes.where("reason is null")
    seen = Observation()
    asked = materialize(
        asking.select(*pair).distinct().join(weather, pair, "left")
        .withColumn("weather_reject", F.when(F.col("decision_ts").isNull() & F.col("weather_reject").isNull(), C.NO_COVERAGE).otherwise(F.col("weather_reject")))
        .observe(seen, *[F.count_if(F.col("weather_class") == c).alias(c) for c in (SINGLE_RUN_COVERAGE, ARCHIVE_COVERAGE)]),
        "weather",
    )
    counters = dict(seen.get)
    placed = asking.join(asked, pair, "left")
    priced = asof_price(
        placed, prices, by=["token_id"], decision_ts="decision_ts", observed_at="observed_at", price="price",
        first_seen=first_seen,
    ).join(price_verdicts, "token_id", "left")
    usable = F.col("weather_reject").isNull()
    stamped = with_identity(
        priced.withColumns({
            "market_probability": F.when(usable, F.col("price")),
            "market_price_observed_at": F.when(usable, F.col("observed_at")),
            "price_status": F.when(usable, F.col("price_status")),
        }).drop("price", "observed_at")
    )
    routed = stamped.withColumn("reason", outcome_reason()).unionByName(
        outcomes.where("reason is not null"), allowMissingColumns=True
    )
    counted = Observation()
    rows = materialize(
        routed.observe(
            counted,
            F.count_if(F.col("reason").isNull()).alias("snapshots_written"),
            F.count_if(F.col("reason").isNotNull()).alias("quarantined"),
            *[F.count_if(F.col("weather_class") == c).alias(c) for c in (SINGLE_RUN_SCHEMA, ARCHIVE_SCHEMA)],
            *[F.count_if(F.col("price_status") == s).alias(n) for s, n in PRICE_ERRORS.items()],
        ),
        "routed",
    )
    return rows, counters | dict(counted.get)
