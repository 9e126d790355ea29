"""Nested provider JSON to flat keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.functions import text as X, times as T, variants as V
from bucketwise.functions.classify import finite_number
from bucketwise.functions.identity import trade_id
from bucketwise.operators.keyed import first_per_key

MARKET_FIELDS = (
    "id string, question string, conditionId string, condition_id string, slug string, "
    "description string, groupItemTitle string, outcomes string, clobTokenIds string, "
    "clob_token_ids string, outcomePrices string, outcome_prices string, closed boolean, "
    "resolved boolean, active boolean, startDate string, start_date string, endDate string, "
    "end_date string, eventDate string, event_date string, date string, eventId string, "
    "event_slug string, eventSlug string, negRiskMarketID string, neg_risk_market_id string, "
    "events array<struct<id:string>>"
)
_MARKET_STRUCT = "struct<" + ", ".join(
    f.strip().replace(" ", ":", 1) for f in MARKET_FIELDS.split(", ")
) + ">"
SEARCH_SCHEMA = (
    f"events array<struct<id:string, slug:string, negRiskMarketID:string, neg_risk_market_id:string, "
    f"markets:array<{_MARKET_STRUCT}>>>, markets array<{_MARKET_STRUCT}>"
)


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def flatten_search(payloads: DataFrame, order: str, payload: str = "payload") -> DataFrame:
    """Markets of search documents, nested before direct, first seen per condition (or id).

    Parent id, slug and family fill a nested market only where its own value is null.
    """
    doc = F.from_json(payload, SEARCH_SCHEMA)
    nested = F.flatten(
        F.transform(
            F.coalesce(doc["events"], F.array()),
            lambda e: F.transform(
                F.coalesce(e["markets"], F.array()),
                lambda m: m.withField("eventId", F.coalesce(m["eventId"], e["id"]))
                .withField("event_slug", F.coalesce(m["event_slug"], e["slug"]))
                .withField(
                    "negRiskMarketID",
                    F.coalesce(m["negRiskMarketID"], _filled(e["negRiskMarketID"], e["neg_risk_market_id"])),
                ),
            ),
        )
    )
    every = F.concat(nested, F.coalesce(doc["markets"], F.array()))
    rows = payloads.select(order, F.posexplode(every).alias("pos", "m")).filter("m IS NOT NULL")
    key = F.coalesce(_filled(F.col("m.conditionId")), F.col("m.id"))
    return first_per_key(rows, [key], [order, "pos"]).select(order, "pos", "m.*")


def event_date_evidence(df: DataFrame) -> DataFrame:
    """Adds ``event_date_found`` and ``date_note`` from structured, question, slug and description dates.

    Contradictions leave the date unresolved; a description can confirm or complete a date, never
    establish one.
    """
    def described(pattern: str, month: int, day: int, year: int, base: int) -> Column:
        col = F.col("description")
        hits = F.arrays_zip(
            F.regexp_extract_all(col, F.lit(pattern), F.lit(month)).alias("m"),
            F.regexp_extract_all(col, F.lit(pattern), F.lit(day)).alias("d"),
            F.regexp_extract_all(col, F.lit(pattern), F.lit(year)).alias("y"),
        )
        return F.transform(
            hits,
            lambda h: T.calendar_date(
                h["y"].try_cast("int") + base, T.month_number(h["m"]), h["d"].try_cast("int")
            ),
        )

    none = F.array().cast("array<string>")
    said = F.coalesce(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    described(C.DESCRIPTION_MDY, 1, 2, 3, 0),
                    described(C.DESCRIPTION_DMY_SHORT, 2, 1, 3, 2000),
                )
            )
        ),
        none,
    )
    staged = df.withColumns(
        {
            "_q": T.date_parts(F.col("question"), C.QUESTION_DATE),
            "_s": T.date_parts(F.col("slug"), C.SLUG_DATE),
            "_said": said,
            "_k1": T.valid_iso_date(F.trim("eventDate")),
            "_k2": T.valid_iso_date(F.trim("event_date")),
            "_k3": T.valid_iso_date(F.trim("date")),
        }
    ).withColumns(
        {
            "_q_iso": T.calendar_date(F.col("_q.year"), F.col("_q.month"), F.col("_q.day")),
            "_s_iso": T.calendar_date(F.col("_s.year"), F.col("_s.month"), F.col("_s.day")),
        }
    )

    def month_day(p: str) -> Column:
        return F.concat(
            F.lpad(F.col(f"{p}.month").cast("string"), 2, "0"), F.lit("-"),
            F.lpad(F.col(f"{p}.day").cast("string"), 2, "0"),
        )

    def named(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value)

    staged = staged.withColumns(
        {
            "_evidence": F.array_compact(
                F.array(
                    named("eventDate", F.col("_k1")), named("event_date", F.col("_k2")),
                    named("date", F.col("_k3")),
                    named("question", F.coalesce("_q_iso", month_day("_q"))),
                    named("slug", F.coalesce("_s_iso", month_day("_s"))),
                )
            ),
            "_support": F.array_distinct(
                F.array_compact(F.array("_k1", "_k2", "_k3", "_q_iso", "_s_iso"))
            ),
        }
    )

    def agrees(p: str, iso: Column) -> Column:
        def same(field: str, start: int, width: int) -> Column:
            part = F.col(f"{p}.{field}")
            return part.isNull() | (part == F.substring(iso, start, width).cast("int"))

        return same("year", 1, 4) & same("month", 6, 2) & same("day", 9, 2)

    candidate = F.get("_support", F.lit(0))
    clash = (
        F.coalesce(month_day("_q") != month_day("_s"), F.lit(False))
        | F.coalesce(F.col("_q.year") != F.col("_s.year"), F.lit(False))
        | (F.size("_support") > 1)
        | ((F.size("_support") == 1) & ~(agrees("_q", candidate) & agrees("_s", candidate)))
    )
    first_said = F.get("_said", F.lit(0))
    confirmed = (
        (F.size("_said") == 1)
        & ((F.size("_support") == 0) | (candidate == first_said))
        & agrees("_q", first_said) & agrees("_s", first_said)
    )
    from_text = F.transform("_said", lambda d: F.concat(F.lit("description="), d))
    conflict = F.concat(
        F.lit("conflicting event dates: "),
        F.array_join(F.concat("_evidence", from_text), "; "), F.lit("; date left unresolved"),
    )
    partial = month_day("_q").isNotNull() | month_day("_s").isNotNull()
    nothing = F.lit(None).cast("string")
    talked = F.size("_said") > 0
    found = (
        F.when(clash, nothing)
        .when(talked & (F.size("_evidence") == 0), nothing)
        .when(talked, F.when(confirmed, first_said))
        .when(F.size("_support") == 1, candidate)
    )
    note = (
        F.when(clash, conflict)
        .when(
            talked & (F.size("_evidence") == 0),
            F.concat(
                F.lit("description date evidence not sufficient to establish event_date: "),
                F.array_join(from_text, "; "),
            ),
        )
        .when(talked, F.when(~confirmed, conflict))
        .when((F.size("_support") != 1) & partial, C.NOTE_NO_YEAR)
    )
    return staged.withColumns({"event_date_found": found, "date_note": note}).drop(
        "_q", "_s", "_said", "_k1", "_k2", "_k3", "_q_iso", "_s_iso", "_evidence", "_support"
    )


def normalize_markets(raw: DataFrame) -> DataFrame:
    """Market rows from raw records with the fields of :data:`MARKET_FIELDS`."""
    clean = raw.withColumns(
        {
            "question": F.trim(F.coalesce("question", F.lit(""))),
            "slug": X.blank_to_null(F.col("slug")),
            "description": X.blank_to_null(F.col("description")),
        }
    )
    dated = event_date_evidence(clean).withColumns(
        {
            "_city": X.city_of(F.col("question"), F.col("slug"), F.col("description")),
            "_station": X.station_of(F.col("description")),
        }
    )
    condition = _filled(F.col("conditionId"), F.col("condition_id"))
    notes = F.array_compact(
        F.array(
            F.col("date_note"), F.col("_station.note"),
            F.when(F.col("_city").isNull(), C.NOTE_CITY),
            F.when(F.col("event_date_found").isNull(), C.NOTE_DATE),
            F.when(F.col("_station.code").isNull(), C.NOTE_STATION),
        )
    )
    question = F.col("question")
    return dated.select(
        F.coalesce(condition, F.concat(F.lit("unknown:"), F.coalesce("id", F.lit("None")))).alias("condition_id"),
        X.blank_to_null(F.col("id")).alias("market_id"),
        F.coalesce(F.get("events", F.lit(0))["id"], F.col("eventId")).alias("event_id"),
        "slug",
        X.blank_to_null(_filled(F.col("event_slug"), F.col("eventSlug"))).alias("event_slug"),
        X.blank_to_null(_filled(F.col("negRiskMarketID"), F.col("neg_risk_market_id"))).alias("neg_risk_market_id"),
        F.when(question != "", question).otherwise("(missing question)").alias("question"),
        "description",
        F.col("_city").alias("city"),
        F.col("_station.code").alias("station_icao"),
        F.col("event_date_found").alias("event_date"),
        X.parse_status(F.col("_city"), F.col("event_date_found"), question).alias("parse_status"),
        notes.alias("parse_notes"),
        "closed", "active",
        T.parse_instant(_filled(F.col("startDate"), F.col("start_date"))).alias("start_time"),
        T.parse_instant(_filled(F.col("endDate"), F.col("end_date"))).alias("end_time"),
    )


def explode_outcomes(
    markets: DataFrame, condition_id: Column, outcomes: Column, tokens: Column, title: Column
) -> DataFrame:
    """One row per outcome; bucket columns only on the row labelled yes."""
    labels, ids = X.json_list(outcomes), X.json_list(tokens)
    count = F.greatest(F.size(labels), F.size(ids))
    rows = (
        markets.withColumns({"_cid": condition_id, "_labels": labels, "_ids": ids, "_title": title})
        .withColumn("_bucket", X.temperature_bucket(X.blank_to_null(F.col("_title"))))
        .withColumn(
            "outcome_index", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
                F.array().cast("array<int>")))
        )
    )
    i = F.col("outcome_index")
    label = F.coalesce(F.get("_labels", i), F.concat(F.lit("outcome-"), i))
    shown = rows.withColumn("outcome_label", label)
    yes = F.lower("outcome_label") == "yes"

    def bucket(field: str) -> Column:
        return F.when(yes, F.col(f"_bucket.{field}"))

    return shown.select(
        F.col("_cid").alias("condition_id"),
        F.coalesce(F.get("_ids", i), F.concat_ws(":", F.col("_cid"), i.cast("string"))).alias("token_id"),
        "outcome_label", "outcome_index",
        bucket("min_c").alias("temperature_celsius_min"),
        bucket("max_c").alias("temperature_celsius_max"),
        bucket("kind").alias("bucket_kind"),
        X.blank_to_null(F.col("_title")).alias("group_item_title"),
        bucket("unit").alias("temperature_unit"),
        bucket("native_min").alias("temperature_native_min"),
        bucket("native_max").alias("temperature_native_max"),
    )


def explode_prices(payloads: DataFrame, keep: list[str], strict: bool = True) -> DataFrame:
    """(keep, observed_at, price) from history documents.

    Strict rows come only from documents whose verdict is ok; the lenient form takes every item
    with a usable time and price, also from bare lists.
    """
    from bucketwise.operators.validate import parsed, price_history_verdict

    docs = parsed(payloads)
    if strict:
        docs = docs.filter(price_history_verdict(F.col("v"))["status"] == "ok")
        found = V.items(F.col("v"), "$.history")
    else:
        found = F.when(V.has(F.col("v"), "$.history"), V.items(F.col("v"), "$.history")).otherwise(
            V.items(F.col("v"), "$")
        )
    rows = docs.select(*keep, F.posexplode(found).alias("pos", "x"))
    price = F.trim(V.text(F.col("x"), "$.p")).try_cast("double")
    observed = F.when(~V.is_kind(F.col("x"), "$.t", "BOOLEAN"), T.parse_instant(V.text(F.col("x"), "$.t")))
    return rows.select(*keep, "pos", observed.alias("observed_at"), price.alias("price")).filter(
        "observed_at IS NOT NULL AND price IS NOT NULL"
    )


TRADE_ID_FIELDS = (
    "transactionHash", "conditionId", "asset", "timestamp", "side", "price", "size", "outcome",
    "outcomeIndex",
)


def judge_trades(raw: DataFrame, order: list[str]) -> DataFrame:
    """Trade columns, ``reject_reason`` and the order columns of every wanted row, whose fields are text.

    Zero prices and sizes are kept; only 0x conditions are asked for. Nothing is deduplicated, so rows judged in
    several batches can be put together before the first row per trade id is taken.
    """
    identity = trade_id({f: F.col(f) for f in TRADE_ID_FIELDS}, [F.col("id")])
    token = X.blank_to_null(F.col("asset"))
    price, size = finite_number(F.col("price")), finite_number(F.col("size"))
    missing = F.array_compact(
        F.array(
            F.when(token.isNull(), F.lit("asset")), F.when(price.isNull(), F.lit("price")),
            F.when(size.isNull(), F.lit("size")),
        )
    )
    reason = F.when(
        F.col("timestamp").isNull(), F.lit("skipped trade: missing timestamp")
    ).when(
        F.size(missing) > 0,
        F.concat(
            F.lit("skipped trade: missing or invalid required field(s) "), F.array_join(missing, ", ")
        ),
    )
    return raw.filter(F.col("market").startswith("0x")).select(
        identity.alias("trade_id"), token.alias("token_id"),
        F.coalesce(F.when(F.col("side") != "", F.col("side")), F.lit("UNKNOWN")).alias("side"),
        price.alias("price"), size.alias("size"),
        T.parse_instant(F.col("timestamp")).alias("traded_at"),
        X.blank_to_null(F.col("transactionHash")).alias("transaction_hash"),
        _filled(F.col("conditionId"), F.col("market")).alias("condition_id"),
        X.blank_to_null(F.col("outcome")).alias("outcome_label"), reason.alias("reject_reason"), *order,
    )


def split_judged(judged: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(trades, rejects): the first judged row per trade id decides."""
    unique = first_per_key(judged, ["trade_id"], order)
    trades = unique.filter("reject_reason IS NULL").drop("reject_reason", *order)
    return trades, unique.filter("reject_reason IS NOT NULL").select("trade_id", "reject_reason")


def normalize_trades(raw: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(trades, rejects) from raw trade rows whose fields are text; first row per trade id."""
    return split_judged(judge_trades(raw, order), order)


BOOK_SCHEMA = (
    "asset_id string, timestamp string, hash string, tick_size string, min_order_size string, "
    "last_trade_price string, bids array<struct<price:string, size:string>>, "
    "asks array<struct<price:string, size:string>>"
)


def flatten_books(payloads: DataFrame, token: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(snapshots, levels): invalid levels are dropped without renumbering the rest."""
    book = payloads.withColumn("b", F.from_json(payload, BOOK_SCHEMA)).withColumn(
        "token_id", F.coalesce(X.blank_to_null(F.col("b.asset_id")), X.blank_to_null(F.col(token)))
    ).filter(F.col("token_id").isNotNull() & (F.col("b.timestamp") != ""))
    ident = F.concat_ws(":", "token_id", "b.timestamp")
    snapshots = book.select(
        ident.alias("snapshot_id"), "token_id",
        T.parse_instant(F.col("b.timestamp")).alias("observed_at"),
        X.blank_to_null(F.col("b.hash")).alias("hash"),
        *[F.col(f"b.{c}").try_cast("double").alias(c)
          for c in ("tick_size", "min_order_size", "last_trade_price")],
    )

    def side(entries: str, name: str) -> Column:
        def level(x: Column, i: Column) -> Column:
            return F.struct(
                F.lit(name).alias("side"), i.alias("level_index"),
                finite_number(x["price"]).alias("price"), finite_number(x["size"]).alias("size"),
            )

        return F.transform(F.coalesce(F.col(f"b.{entries}"), F.array()), level)

    sides = F.concat(side("bids", "bid"), side("asks", "ask"))
    levels = book.select(ident.alias("snapshot_id"), F.inline(sides)).filter(
        "price IS NOT NULL AND size IS NOT NULL"
    )
    return snapshots, levels


# ---- weather documents ---------------------------------------------------------------------------------

def weather_documents(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds zone, offset, series maps and ``valid_times``: localized times by position, null = dropped.

    Repeats of a wall time are counted inside the document, so no shuffle is needed. Each step that others build on is a
    column of its own, so a document is parsed once.
    """
    v = F.col("_v")

    def series(block: str) -> Column:
        return F.coalesce(
            F.try_variant_get(v, f"$.{block}", "map<string,variant>"),
            F.create_map().cast("map<string,variant>"),
        )

    def names(block: str) -> Column:
        return F.coalesce(
            F.from_json(F.get_json_object(payload, f"$.{block}"), "map<string,string>"),
            F.create_map().cast("map<string,string>"),
        )

    docs = payloads.withColumn("_v", F.try_parse_json(payload)).withColumns(
        {
            "doc_zone": F.get_json_object(payload, "$.timezone"),
            "doc_offset": F.coalesce(F.get_json_object(payload, "$.utc_offset_seconds").try_cast("int"), F.lit(0)),
            "hourly": F.map_filter(series("hourly"), lambda k, s: V.is_kind(s, None, "ARRAY")),
            "hourly_units": names("hourly_units"),
            "daily": F.map_filter(series("daily"), lambda k, s: V.is_kind(s, None, "ARRAY")),
            "daily_units": names("daily_units"),
        }
    )
    walls = F.coalesce(
        F.try_variant_get(F.try_element_at("hourly", F.lit("time")), "$", "array<string>"),
        F.array().cast("array<string>"),
    )
    docs = docs.withColumn("_walls", T.occurrences(walls)).withColumn("known_zone", T.checked_zone(F.col("doc_zone")))

    def instant(x: Column) -> Column:
        w = x["wall"]
        zoned = w.rlike(r"(Z|UTC)$") | w.rlike(r"^.{10}.*[+-]\d{2}(:?\d{2})?(:\d{2})?$")
        return F.when(zoned, T.parse_instant(F.regexp_replace(w, "UTC$", "Z"))).otherwise(
            T.local_to_utc(T.local_stamp(w), F.col("known_zone"), F.col("doc_offset"), x["nth"])
        )

    return docs.withColumn("valid_times", F.transform("_walls", instant)).drop("_walls", "_v")


def _quantity(value: Column, unit: Column, variable: Column) -> list[Column]:
    celsius = F.when(X.is_temperature_variable(variable), X.to_celsius(value, unit))
    return [value.alias("source_value"), unit.alias("source_unit"), celsius.alias("temperature_celsius")]


# Documents are opened by outer generators, and what these add for an empty list is dropped behind them: of an inner
# one the planner makes a filter on the list's size, moves it below the parsing and so parses again for every mention.


def unpivot_hourly(docs: DataFrame, keep: list[str], archive: Column) -> DataFrame:
    """Every hourly series as rows, routed to observation, ensemble or forecast."""
    long = (
        docs.select(
            *keep, archive.alias("_archive"), "valid_times", "hourly_units",
            F.explode_outer(F.map_filter("hourly", lambda k, s: k != "time")).alias("key", "_series"),
        )
        .filter("key IS NOT NULL")
        .withColumn("_values", F.try_variant_get("_series", "$", "array<string>"))
        .select(
            *keep, "_archive", "key", F.try_element_at("hourly_units", F.col("key")).alias("_unit"),
            "_values", F.posexplode_outer("valid_times").alias("_i", "valid_time"),
        )
        .filter("valid_time IS NOT NULL")
    )
    value = F.get("_values", F.col("_i")).try_cast("double")
    member = F.regexp_extract("key", C.MEMBER_KEY, 2)
    is_member = member != ""
    return long.select(
        *keep,
        F.when(is_member, "ensemble").when(F.col("_archive"), "observation").otherwise("forecast").alias("target"),
        F.when(is_member, F.regexp_extract("key", C.MEMBER_KEY, 1)).otherwise(F.col("key")).alias("variable"),
        F.when(is_member, F.concat(F.lit("member"), member)).alias("member_id"),
        "valid_time",
        *_quantity(value, F.col("_unit"), F.col("key")),
    )


def explode_daily(docs: DataFrame, keep: list[str], archive: Column) -> DataFrame:
    """Daily maxima: archive days stay days, forecast days become rows at local midnight."""
    dates = F.try_variant_get(F.try_element_at("daily", F.lit("time")), "$", "array<string>")
    tops = F.try_variant_get(F.try_element_at("daily", F.lit("temperature_2m_max")), "$", "array<string>")
    rows = docs.select(
        *keep, archive.alias("_archive"), "doc_zone", "known_zone", "doc_offset", "daily_units", tops.alias("_tops"),
        F.posexplode_outer(F.when(tops.isNotNull(), dates)).alias("_i", "_day"),
    ).filter("_i IS NOT NULL")
    day = F.substring("_day", 1, 10)
    midnight = day.try_cast("date").cast("timestamp")
    # a midnight inside a spring gap falls back to the document's fixed offset
    fixed = F.timestamp_micros(
        F.unix_micros(midnight) - F.col("doc_offset").cast("bigint") * F.lit(1_000_000)
    )
    valid = F.coalesce(
        T.local_to_utc(midnight, F.col("known_zone"), F.col("doc_offset"), F.lit(0)), fixed
    )
    unit = F.try_element_at("daily_units", F.lit("temperature_2m_max"))
    value = F.get("_tops", F.col("_i")).try_cast("double")
    return rows.select(
        *keep, F.when(F.col("_archive"), "daily").otherwise("forecast").alias("target"),
        F.when(F.col("_archive"), day).alias("local_date"),
        F.when(F.col("_archive"), F.coalesce("doc_zone", F.lit("GMT"))).alias("timezone_name"),
        F.when(~F.col("_archive"), valid).alias("valid_time"),
        *_quantity(value, unit, F.lit("temperature_2m_max")),
    )


def run_cube(docs: DataFrame, keep: list[str], station_zone: Column) -> DataFrame:
    """Wide hourly rows of a forecast run; the local date follows the station's zone."""
    cols = {
        name: F.try_variant_get(F.try_element_at("hourly", F.lit(series)), "$", "array<string>")
        for name, series in zip(C.HOURLY_FEATURES, C.HOURLY_SERIES)
    }
    rows = docs.select(
        *keep, station_zone.alias("_zone"), *[c.alias(f"_{n}") for n, c in cols.items()],
        F.posexplode_outer("valid_times").alias("_i", "valid_time"),
    ).filter("valid_time IS NOT NULL")
    return rows.select(
        *keep, "valid_time", T.local_date(F.col("valid_time"), F.col("_zone")).alias("local_date"),
        *[F.get(f"_{n}", F.col("_i")).try_cast("double").alias(n) for n in cols],
    )


def stamp_provenance(
    rows: DataFrame, *, provider: str, issued_at: Column, request_url: Column, raw_path: Column,
    content_sha256: Column, retrieved_at: Column,
) -> DataFrame:
    """Adds the six provenance columns; limitation texts depend on provider and issue time."""
    if "ensemble" in provider:
        texts = C.ENSEMBLE_LIMITATIONS
    elif "archive" in provider:
        texts = C.ARCHIVE_LIMITATIONS
    else:
        texts = C.STITCHED_LIMITATIONS
    base = F.array(*[F.lit(t) for t in texts])
    if "archive" not in provider:
        base = F.when(issued_at.isNull(), F.concat(base, F.array(F.lit(C.NO_ISSUE_TIME)))).otherwise(base)
    return rows.withColumns(
        {
            "source": F.lit(provider), "retrieved_at": retrieved_at, "request_url": request_url,
            "raw_path": raw_path, "content_sha256": content_sha256, "limitations": base,
        }
    )
