"""Payload verdicts: (status, provider, detail, eligibility) per raw document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.functions import variants as V
from bucketwise.functions.text import is_topic_blob, topic_blob
from bucketwise.functions.times import is_known_zone, local_date_token, local_stamp, valid_iso_date


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``v``, the document as a variant (null when it is not JSON)."""
    return df.withColumn("v", F.try_parse_json(payload))


def _verdict(
    provider: str, drift: Column, drift_text: str | Column, fault: Column, empty: Column,
    eligibility: Column | None = None, ineligible_text: str | None = None,
) -> Column:
    """The verdict from a drift, the first fault (null: none) and emptiness; each is made once, eligibility for sound documents only."""
    none = F.lit(None).cast("string")

    def level(c: Column) -> Column:
        status = (
            F.when(c["drifted"], "source_drift").when(c["fault"].isNotNull(), "malformed").when(c["empty"], "empty")
            .otherwise("ok")
        )
        judged = F.lit("not_applicable") if eligibility is None else F.when(
            ~c["drifted"] & c["fault"].isNull() & ~F.coalesce(c["empty"], F.lit(False)), eligibility
        ).otherwise("not_applicable")
        return F.struct(
            status.alias("status"),
            F.when(c["drifted"], drift_text).otherwise(c["fault"]).alias("detail"), judged.alias("eligibility"),
        )

    def body(c: Column) -> Column:
        ineligible = F.when(c["eligibility"] == "ineligible", ineligible_text) if ineligible_text else none
        return F.struct(
            c["status"].alias("status"), F.lit(provider).alias("provider"),
            F.coalesce(c["detail"], ineligible).alias("detail"), c["eligibility"].alias("eligibility"),
        )

    checks = F.struct(
        F.coalesce(drift, F.lit(False)).alias("drifted"), fault.alias("fault"), empty.alias("empty")
    )
    return V.held(V.held(checks, level), body)


def price_history_verdict(v: Column) -> Column:
    def item_fault(x: Column) -> Column:
        return (
            F.when(~V.is_kind(x, None, "OBJECT"), "prices-history nested record must be an object")
            .when(~V.has(x, "$.t") | ~V.has(x, "$.p"), "prices-history nested record missing t or p")
            .when(~V.valid_instant(x, "$.t"), "prices-history nested record has invalid t")
            .when(~V.valid_probability(x, "$.p"), "prices-history nested record has invalid p")
        )

    is_object = V.is_kind(v, None, "OBJECT")
    history = V.items(v, "$.history")
    drift = is_object & (V.has(v, "$.error") | V.has(v, "$.message")) & ~V.has(v, "$.history")
    errors = F.concat(
        F.array(
            F.when(~is_object, "prices-history payload must be an object")
            .when(~V.has(v, "$.history"), "prices-history missing required history key")
            .when(~V.is_kind(v, "$.history", "ARRAY"), "prices-history history must be a list")
        ),
        F.transform(history, item_fault),
    )
    return _verdict(
        C.PROVIDER_PRICES, drift,
        "prices-history error/message object is not a valid history container",
        V.first_text(errors), F.size(history) == 0,
    )


# what a search document is judged by; a value that is no object or list reads as null
MARKET_FIELDS = (
    "struct<id: variant, conditionId: variant, question: string, slug: string, groupItemTitle: string, group_item_title: string, "
    "clobTokenIds: variant, tokens: variant, clob_token_ids: variant>"
)
SEARCH_FIELDS = f"struct<events: array<struct<id: variant, markets: array<{MARKET_FIELDS}>>>, markets: array<{MARKET_FIELDS}>>"


def _filled_id(x: Column) -> Column:
    return V.is_kind(x, None, "NUMBER", "BOOLEAN") | (
        V.is_kind(x, None, "STRING") & (F.trim(V.text(x, "$")) != "")
    )


def _market_fault(m: Column) -> Column:
    by_condition = m["conditionId"].isNotNull() & ~F.is_variant_null(m["conditionId"])
    identified = F.when(by_condition, _filled_id(m["conditionId"])).otherwise(_filled_id(m["id"]))
    return F.when(m.isNull(), "gamma search market must be an object").when(
        ~identified, "gamma search market missing required identity"
    )


def _market_eligible(m: Column) -> Column:
    def filled(name: str) -> Column:
        return F.coalesce(F.trim(m[name]) != "", F.lit(False))

    def tokens(name: str) -> Column:
        word = F.trim(V.text(m[name], "$"))
        return F.coalesce(
            F.when(V.is_kind(m[name], None, "ARRAY"), F.size(V.items(m[name], "$")) > 0).when(
                V.is_kind(m[name], None, "STRING"), ~word.isin("", "[]", "null")
            ),
            F.lit(False),
        )

    topical = V.held(topic_blob(m["question"], m["slug"]), is_topic_blob)
    return (
        topical
        & (filled("groupItemTitle") | filled("group_item_title"))
        & (tokens("clobTokenIds") | tokens("tokens") | tokens("clob_token_ids"))
    )


def search_verdict(v: Column) -> Column:
    """Verdict of a search document. Its fields are read in one typed pass; faults count in document order."""
    return V.held(F.struct(v.alias("v"), F.try_variant_get(v, "$", SEARCH_FIELDS).alias("d")), _search_verdict)


def _search_verdict(c: Column) -> Column:
    v, events, markets = c["v"], c["d"]["events"], c["d"]["markets"]

    def first_fault(xs: Column, fault) -> Column:
        return V.first_text(F.transform(xs, fault))

    def event_fault(e: Column) -> Column:
        own = (
            F.when(e.isNull(), "gamma search event must be an object")
            .when(~_filled_id(e["id"]), "gamma search event missing nonempty parent id")
            .when(e["markets"].isNull(), "gamma search event markets must be a list")
        )
        return F.coalesce(own, first_fault(e["markets"], _market_fault))

    is_object = V.is_kind(v, None, "OBJECT")
    has_events, has_markets = V.has(v, "$.events"), V.has(v, "$.markets")
    error = V.has(v, "$.error")
    lists = (
        F.when(~is_object, "gamma search payload must be an object")
        .when(has_events & events.isNull(), "gamma search events must be a list")
        .when(has_markets & markets.isNull(), "gamma search markets must be a list")
    )
    fault = F.coalesce(lists, first_fault(events, event_fault), first_fault(markets, _market_fault))
    nothing = lambda xs: xs.isNull() | (F.size(xs) == 0)
    nested = F.exists(events, lambda e: F.exists(e["markets"], _market_eligible))
    eligible = F.coalesce(nested, F.lit(False)) | F.coalesce(F.exists(markets, _market_eligible), F.lit(False))
    return _verdict(
        C.PROVIDER_SEARCH, is_object & (error | (~has_events & ~has_markets)),
        F.when(error, "gamma search error object is not a valid search container").otherwise(
            "gamma search missing events/markets containers"
        ),
        fault, nothing(events) & nothing(markets), F.when(eligible, "eligible").otherwise("ineligible"),
        "structurally valid gamma payload lacks Phase 3 weather eligibility fields",
    )


def _zone_fault(v: Column, provider: str) -> Column:
    zone = V.text(v, "$.timezone")
    whole = V.is_kind(v, "$.utc_offset_seconds", "NUMBER") & F.schema_of_variant(
        F.try_variant_get(v, "$.utc_offset_seconds", "variant")
    ).startswith("BIGINT")
    return (
        F.when(
            ~V.is_kind(v, "$.timezone", "STRING") | (F.trim(zone) == ""),
            f"{provider} timezone must be nonempty string",
        )
        .when(~is_known_zone(zone), f"{provider} timezone invalid")
        .when(~whole, f"{provider} utc_offset_seconds must be int")
    )


def _series_verdict(
    v: Column, *, provider: str, noun: str, block: str, value: str, stamp_ok, stamp_text: str,
    ancillary: bool,
) -> Column:
    times, temps = V.items(v, f"$.{block}.time"), V.items(v, f"$.{block}.{value}")
    is_object = V.is_kind(v, None, "OBJECT")
    unit = F.lower(F.trim(V.text(v, f"$.{block}_units.{value}")))
    head = (
        F.when(~is_object, f"{provider} payload must be an object")
        .otherwise(_zone_fault(v, provider))
    )
    shape = (
        F.when(~V.is_kind(v, f"$.{block}", "OBJECT"), f"{provider} {block} must be an object")
        .when(
            ~V.has(v, f"$.{block}.time") | ~V.has(v, f"$.{block}.{value}"),
            f"{provider} {block} missing time/{value}",
        )
        .when(
            ~V.is_kind(v, f"$.{block}.time", "ARRAY") | ~V.is_kind(v, f"$.{block}.{value}", "ARRAY"),
            f"{provider} {block} time/{value} must be lists",
        )
        .when(F.size(times) != F.size(temps), f"{provider} {block} time/{value} length mismatch")
        .when(
            ~F.coalesce(unit.isin(*C.CELSIUS_UNITS), F.lit(False)), f"{provider} {value} unit must be Celsius"
        )
        .when(F.exists(times, lambda t: ~stamp_ok(t)), f"{provider} {stamp_text}")
        .when(
            F.exists(temps, lambda t: ~V.finite_or_null(t)), f"{provider} {block} temperature invalid"
        )
    )
    faults = [head, shape]
    errors = F.array(*faults)
    if ancillary:
        others = F.map_entries(
            F.map_filter(
                F.coalesce(
                    F.try_variant_get(v, f"$.{block}", "map<string,variant>"),
                    F.create_map().cast("map<string,variant>"),
                ),
                lambda k, s: ~k.isin("time", value) & ~V.is_kind(s, None, "NULL"),
            )
        )

        def series_fault(e: Column) -> Column:
            rows = V.items(e["value"], "$")
            aligned = V.is_kind(e["value"], None, "ARRAY") & (F.size(rows) == F.size(times))
            return F.when(
                ~aligned, F.concat(F.lit(f"{provider} ancillary series "), e["key"], F.lit(" misaligned"))
            ).when(
                F.exists(rows, lambda x: ~V.finite_or_null(x)),
                F.concat(F.lit(f"{provider} ancillary series "), e["key"], F.lit(" invalid")),
            )

        errors = F.concat(errors, F.transform(others, series_fault))
    return _verdict(
        provider, is_object & V.has(v, "$.error"),
        f"{provider} error object is not a valid {noun} container", V.first_text(errors), F.size(times) == 0,
    )


def run_verdict(v: Column) -> Column:
    """Forecast-run document; with several faulty side series the first in key order is named."""

    def stamp_ok(t: Column) -> Column:
        return V.is_kind(t, None, "STRING") & local_stamp(V.text(t, "$")).isNotNull()

    return _series_verdict(
        v, provider=C.PROVIDER_RUN, noun="forecast", block="hourly", value="temperature_2m",
        stamp_ok=stamp_ok, stamp_text="hourly timestamp invalid", ancillary=True,
    )


def archive_verdict(v: Column) -> Column:
    def stamp_ok(t: Column) -> Column:
        return V.is_kind(t, None, "STRING") & valid_iso_date(V.text(t, "$")).isNotNull()

    return _series_verdict(
        v, provider=C.PROVIDER_ARCHIVE, noun="archive", block="daily", value="temperature_2m_max",
        stamp_ok=stamp_ok, stamp_text="daily date invalid", ancillary=False,
    )


def semantic_class(status: Column, eligibility: Column) -> Column:
    return (
        F.when(status == "http_failure", "http_network_failure")
        .when(status.isin("malformed", "source_drift"), "schema_error")
        .when(status == "empty", "valid_empty")
        .when((status == "ok") & (eligibility == "ineligible"), "schema_valid_phase3_ineligible")
        .when(status == "ok", "schema_valid_eligible")
        .otherwise("schema_error")
    )


def counter_class(status: Column) -> Column:
    return F.when(status.isin("malformed", "source_drift"), "schema_error").otherwise(status)


# ---- target-date coverage -------------------------------------------------------------------------

def _coverage(status: Column, detail: Column) -> Column:
    eligibility = (
        F.when(status == "eligible", "eligible").when(status == "empty", "not_applicable")
        .otherwise("ineligible")
    )
    return F.struct(
        status.alias("status"),
        F.when(status != "eligible", C.NO_COVERAGE).alias("reason"),
        detail.alias("detail"), eligibility.alias("eligibility"),
    )


def hourly_coverage(v: Column, event_date: Column) -> Column:
    """Eligible when at least one finite temperature falls on the provider-local date."""
    times = V.items(v, "$.hourly.time")
    temps = V.items(v, "$.hourly.temperature_2m")
    lists = V.is_kind(v, "$.hourly.time", "ARRAY") & V.is_kind(v, "$.hourly.temperature_2m", "ARRAY")
    on_date = F.zip_with(
        times, temps,
        lambda t, x: F.when(
            V.is_kind(t, None, "STRING") & (local_date_token(V.text(t, "$")) == event_date),
            F.coalesce(V.is_finite(x), F.lit(False)),
        ),
    )
    usable = F.exists(on_date, lambda b: F.coalesce(b, F.lit(False)))
    seen = F.exists(on_date, lambda b: b.isNotNull())
    detail = (
        F.when(~V.is_kind(v, None, "OBJECT"), "single_run_payload_not_object")
        .when(~V.is_kind(v, "$.hourly", "OBJECT"), "single_run_hourly_missing")
        .when(~lists, "single_run_time_temp_not_lists")
        .when(F.size(times) == 0, "single_run_aligned_empty")
        .when(usable, F.lit(None).cast("string"))
        .when(seen, "single_run_target_date_all_null")
        .otherwise("single_run_target_date_absent")
    )
    status = (
        F.when(detail.isNull(), "eligible").when(detail == "single_run_aligned_empty", "empty")
        .otherwise("ineligible")
    )
    return _coverage(status, detail)


def daily_coverage(v: Column, event_date: Column) -> Column:
    """The first exact date match decides."""
    times = V.items(v, "$.daily.time")
    temps = V.items(v, "$.daily.temperature_2m_max")
    lists = V.is_kind(v, "$.daily.time", "ARRAY") & V.is_kind(v, "$.daily.temperature_2m_max", "ARRAY")
    names = F.transform(times, lambda t: F.when(V.is_kind(t, None, "STRING"), V.text(t, "$")))
    position = F.array_position(names, event_date)
    hit = F.get(temps, (position - 1).cast("int"))
    detail = (
        F.when(~V.is_kind(v, None, "OBJECT"), "archive_payload_not_object")
        .when(~V.is_kind(v, "$.daily", "OBJECT"), "archive_daily_missing")
        .when(~lists, "archive_time_temp_not_lists")
        .when(F.size(times) == 0, "archive_aligned_empty")
        .when(F.coalesce(position, F.lit(0)) == 0, "archive_target_date_absent")
        .when(~F.coalesce(V.is_finite(hit), F.lit(False)), "archive_target_date_null_max")
    )
    status = (
        F.when(detail.isNull(), "eligible").when(detail == "archive_aligned_empty", "empty")
        .otherwise("ineligible")
    )
    return _coverage(status, detail)


def coverage_detail(
    result: Column, provider: str, raw_path: Column, request_url: Column, content_hash: Column
) -> Column:
    """Quarantine text; absent parts are left out."""

    def part(name: str, col: Column) -> Column:
        return F.when(F.coalesce(col != "", F.lit(False)), F.concat(F.lit(f"{name}="), col))

    return F.concat_ws(
        "; ", F.lit(C.NO_COVERAGE), F.lit(f"provider={provider}"), part("status", result["status"]),
        part("detail", result["detail"]), part("raw", raw_path), part("url", request_url),
        part("hash", content_hash),
    )


def ingest_counters(verdicts: DataFrame) -> DataFrame:
    """(provider, semantic_class, documents) over all verdict rows."""
    return verdicts.groupBy(
        "provider", semantic_class(F.col("status"), F.col("eligibility")).alias("semantic_class")
    ).agg(F.count(F.lit(1)).alias("documents"))
