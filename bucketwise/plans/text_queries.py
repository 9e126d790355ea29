"""Market text, search documents and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.functions import text as X
from bucketwise.functions.identity import canonical_url
from bucketwise.operators import normalize as N
from bucketwise.plans.bindings import SEARCH_DOC, DUCK, market_sql, markets, search_payloads, snapshots, table, snapshot_sql
from bucketwise.plans.registry import query, rounded
from bucketwise.sources.scratch import materialize

B5 = market_sql()


def raw_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market binding under the provider's field names."""
    m = markets(spark, sf_dir)
    none = F.lit(None).cast("string")
    return m.select(
        "o_orderkey", "id", F.col("condition_id").alias("conditionId"), none.alias("condition_id"),
        "question", "slug", "description", F.col("title").alias("groupItemTitle"), "outcomes",
        F.col("tokens").alias("clobTokenIds"), none.alias("clob_token_ids"),
        F.col("outcome_prices").alias("outcomePrices"), none.alias("outcome_prices"), "closed", "resolved",
        F.lit(None).cast("boolean").alias("active"), F.col("start_text").alias("startDate"),
        none.alias("start_date"), F.col("end_text").alias("endDate"), none.alias("end_date"),
        F.col("event_day").alias("eventDate"), none.alias("event_date"), none.alias("date"),
        F.col("event_ref").alias("eventId"), none.alias("event_slug"), none.alias("eventSlug"),
        none.alias("negRiskMarketID"), none.alias("neg_risk_market_id"),
        F.lit(None).cast("array<struct<id:string>>").alias("events"),
    )


Q = ("(?i)(?:will\\s+the\\s+)?highest\\s+temperature\\s+in\\s+(?:new\\s+york|paris|london|munich|amsterdam|milan)(?:\\s+city)?"
     "(?:\\s+be\\s+[^?]+?)?\\s+on\\s+([A-Za-z]+)\\s+(\\d{1,2})(?:[a-z]{2})?(?:,?\\s*(\\d{4}))?")
S = ("(?i)(?:will-the-)?highest-temperature-in-(?:new-york|paris|london|munich|amsterdam|milan)(?:-city)?(?:-be-[^-]+?)?"
     "-on-([a-z]+)-(\\d{1,2})(?:-(\\d{4}))?")
MDY = "(?i)\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\s+(\\d{1,2}),?\\s+(20\\d{2})\\b"
DMY = "\\b(\\d{1,2})\\s+([A-Za-z]{3,9})\\s+''?(\\d{2})\\b"


def _part(col: str, pattern: str, i: int) -> str:
    return f"nullif(regexp_extract({col}, '{pattern}', {i}), '')"


def _month(x: str) -> str:
    return f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({x}, 1, 3)))"


def _date(y: str, m: str, d: str) -> str:
    return f"strftime(try_cast(printf('%04d-%02d-%02d', cast({y} AS int), cast({m} AS int), cast({d} AS int)) AS date), '%Y-%m-%d')"


def _agree(p: str, iso: str) -> str:
    return (f"(({p}y IS NULL OR {p}y = cast(substr({iso}, 1, 4) AS int)) AND ({p}m IS NULL OR {p}m = cast(substr({iso}, 6, 2) AS int)) "
            f"AND ({p}d IS NULL OR {p}d = cast(substr({iso}, 9, 2) AS int)))")


DATE_SQL = f"""{B5}, d0 AS (SELECT *, {_month(_part('question', Q, 1))} AS qm, cast({_part('question', Q, 2)} AS int) AS qd,
    cast({_part('question', Q, 3)} AS int) AS qy, {_month(_part('slug', S, 1))} AS sm, cast({_part('slug', S, 2)} AS int) AS sd,
    cast({_part('slug', S, 3)} AS int) AS sy,
    coalesce({_date(_part('description', MDY, 3), _month(_part('description', MDY, 1)), _part('description', MDY, 2))},
      {_date('2000 + cast(' + _part('description', DMY, 3) + ' AS int)', _month(_part('description', DMY, 2)), _part('description', DMY, 1))}) AS said
  FROM b5),
d1 AS (SELECT *, CASE WHEN qy IS NOT NULL THEN {_date('qy', 'qm', 'qd')} END AS q_iso,
    CASE WHEN sy IS NOT NULL THEN {_date('sy', 'sm', 'sd')} END AS s_iso,
    CASE WHEN qm IS NOT NULL THEN printf('%02d-%02d', cast(qm AS int), qd) END AS q_md,
    CASE WHEN sm IS NOT NULL THEN printf('%02d-%02d', cast(sm AS int), sd) END AS s_md FROM d0),
d2 AS (SELECT *, list_distinct(list_filter([event_day, q_iso, s_iso], lambda x: x IS NOT NULL)) AS support,
    concat_ws('; ', 'eventDate=' || event_day, 'question=' || coalesce(q_iso, q_md), 'slug=' || coalesce(s_iso, s_md)) AS evidence FROM d1),
d3 AS (SELECT *, coalesce(q_md <> s_md, false) OR coalesce(qy <> sy, false) OR len(support) > 1
    OR (len(support) = 1 AND NOT ({_agree('q', 'support[1]')} AND {_agree('s', 'support[1]')})) AS clash,
    said IS NOT NULL AND (len(support) = 0 OR support[1] = said) AND {_agree('q', 'said')} AND {_agree('s', 'said')} AS confirmed,
    'conflicting event dates: ' || concat_ws('; ', nullif(evidence, ''), 'description=' || said) || '; date left unresolved' AS conflict FROM d2),
dated AS (SELECT *, CASE WHEN clash THEN NULL WHEN said IS NOT NULL THEN CASE WHEN evidence <> '' AND confirmed THEN said END
      WHEN len(support) = 1 THEN support[1] END AS event_date,
    CASE WHEN clash THEN conflict
      WHEN said IS NOT NULL AND evidence = '' THEN 'description date evidence not sufficient to establish event_date: description=' || said
      WHEN said IS NOT NULL AND NOT confirmed THEN conflict WHEN said IS NOT NULL THEN NULL
      WHEN len(support) <> 1 AND (q_md IS NOT NULL OR s_md IS NOT NULL) THEN 'year missing; date not synthesized' END AS date_note FROM d3)"""


@query("event_date_evidence", f"WITH {DATE_SQL} SELECT o_orderkey, event_date, date_note FROM dated")
def event_date_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.event_date_evidence(raw_markets(spark, sf_dir))
    return out.select("o_orderkey", F.col("event_date_found").alias("event_date"), "date_note")


TEXT_SQL = f"""{DATE_SQL}, tx AS (SELECT *, replace(concat_ws(' ', question, slug, description), '-', ' ') AS blob,
    nullif(upper(regexp_extract(description, '(?i)/([A-Z]{{4}})(?:[/?#]|\\W|$)', 1)), '') AS by_path,
    list_distinct(regexp_extract_all(upper(description), '\\(([A-Z]{{4}})\\)', 1)) AS codes FROM dated),
ty AS (SELECT *, CASE WHEN regexp_matches(blob, '(?i)\\bamsterdam\\b') THEN 'amsterdam' WHEN regexp_matches(blob, '(?i)\\bnew york\\b') THEN 'new york'
      WHEN regexp_matches(blob, '(?i)\\blondon\\b') THEN 'london' WHEN regexp_matches(blob, '(?i)\\bmunich\\b') THEN 'munich'
      WHEN regexp_matches(blob, '(?i)\\bmilan\\b') THEN 'milan' WHEN regexp_matches(blob, '(?i)\\bparis\\b') THEN 'paris' END AS city,
    CASE WHEN by_path IS NOT NULL THEN by_path WHEN len(codes) = 1 THEN codes[1] END AS station_icao,
    CASE WHEN by_path IS NULL AND len(codes) > 1 THEN 'multiple ICAO-like tokens; station left unresolved' END AS station_note FROM tx),
mk AS (SELECT *, CASE WHEN city IS NOT NULL AND event_date IS NOT NULL AND lower(question) LIKE '%temperature%' THEN 'resolved'
      WHEN city IS NOT NULL OR event_date IS NOT NULL OR lower(question) LIKE '%temperature%' THEN 'partial' ELSE 'unresolved' END AS parse_status,
    concat_ws(' | ', date_note, station_note, CASE WHEN city IS NULL THEN 'city not identified among configured research cities' END,
      CASE WHEN event_date IS NULL THEN 'event date not parsed; question retained' END,
      CASE WHEN station_icao IS NULL THEN 'station ICAO not found in source text; not inferred' END) AS parse_notes FROM ty)"""


@query(
    "market_text",
    f"""WITH {TEXT_SQL} SELECT coalesce(condition_id, 'unknown:' || id) AS condition_id, id AS market_id, event_ref AS event_id, slug, question,
    description, city, station_icao, event_date, parse_status, parse_notes, closed,
    CASE WHEN o_orderkey % 10 <> 1 THEN left(start_text, 19) END AS start_time,
    strftime(to_timestamp(cast(end_text AS double) / CASE WHEN length(end_text) > 11 THEN 1000 ELSE 1 END) AT TIME ZONE 'UTC',
      '%Y-%m-%dT%H:%M:%S') AS end_time FROM mk""",
)
def market_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.normalize_markets(raw_markets(spark, sf_dir))
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return out.select(
        "condition_id", "market_id", "event_id", "slug", "question", "description", "city", "station_icao",
        "event_date", "parse_status", F.array_join("parse_notes", " | ").alias("parse_notes"), "closed",
        F.date_format("start_time", fmt).alias("start_time"), F.date_format("end_time", fmt).alias("end_time"),
    )


NUM = "[+-]?\\d+(?:\\.\\d+)?"
UNIT = "(C|F|Celsius|Fahrenheit)?"
RANGE = f"(?i)^\\s*({NUM})\\s*[-–]\\s*({NUM})\\s*°?\\s*{UNIT}\\s*$"
BELOW = f"(?i)^\\s*({NUM})\\s*°?\\s*{UNIT}\\s+or\\s+(?:below|lower|less)\\s*$"
ABOVE = f"(?i)^\\s*({NUM})\\s*°?\\s*{UNIT}\\s+or\\s+(?:higher|above|more)\\s*$"
EXACT = f"(?i)^\\s*({NUM})\\s*°?\\s*{UNIT}\\s*$"


def bucket_sql(source: str) -> str:
    """CTE bk: kind, unit and native and Celsius bounds of ``title``."""
    return f"""bk0 AS (SELECT *, trim(title) AS lab, CASE WHEN regexp_matches(trim(title), '{RANGE}') THEN 'range' WHEN regexp_matches(trim(title), '{BELOW}') THEN 'below'
      WHEN regexp_matches(trim(title), '{ABOVE}') THEN 'above' WHEN regexp_matches(trim(title), '{EXACT}') THEN 'exact' END AS k0 FROM {source}),
bk1 AS (SELECT *, CASE k0 WHEN 'range' THEN regexp_extract(lab, '{RANGE}', 3) WHEN 'below' THEN regexp_extract(lab, '{BELOW}', 2)
      WHEN 'above' THEN regexp_extract(lab, '{ABOVE}', 2) WHEN 'exact' THEN regexp_extract(lab, '{EXACT}', 2) END AS word,
    try_cast(regexp_extract(lab, '^\\s*({NUM})', 1) AS double) AS a,
    CASE WHEN k0 = 'range' THEN try_cast(regexp_extract(lab, '{RANGE}', 2) AS double) ELSE try_cast(regexp_extract(lab, '^\\s*({NUM})', 1) AS double) END AS b FROM bk0),
bk2 AS (SELECT *, CASE WHEN k0 IS NULL THEN NULL WHEN word <> '' THEN upper(substr(word, 1, 1))
      WHEN regexp_full_match(lab, '{NUM}') OR regexp_full_match(lab, '{NUM}\\s*[-–]\\s*{NUM}') THEN 'C' END AS unit FROM bk1),
bk AS (SELECT *, CASE WHEN unit IS NOT NULL THEN k0 END AS kind, CASE WHEN unit IS NOT NULL AND k0 <> 'below' THEN least(a, b) END AS native_min,
    CASE WHEN unit IS NOT NULL AND k0 <> 'above' THEN greatest(a, b) END AS native_max FROM bk2)"""


CELSIUS = "round(CASE WHEN unit = 'F' THEN ({x} - 32) * 5 / 9 ELSE {x} END, 6)"


@query(
    "bucket_label",
    f"""WITH {B5}, {bucket_sql('b5')} SELECT o_orderkey, title, kind, unit, native_min, native_max,
    {CELSIUS.format(x='native_min')} AS min_c, {CELSIUS.format(x='native_max')} AS max_c FROM bk""",
)
def bucket_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markets(spark, sf_dir)
    rows = m.select("o_orderkey", "title", X.temperature_bucket(F.col("title")).alias("b"))
    return rounded(
        rows.select("o_orderkey", "title", *[F.col(f"b.{c}").alias(c) for c in
                    ("kind", "unit", "native_min", "native_max", "min_c", "max_c")])
    )


@query("station_code", f"WITH {TEXT_SQL} SELECT o_orderkey, station_icao AS code, station_note AS note, city FROM ty")
def station_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markets(spark, sf_dir)
    s = X.station_of(F.col("description"))
    return m.select(
        "o_orderkey", s["code"].alias("code"), s["note"].alias("note"),
        X.city_of(F.col("question"), F.col("slug"), F.col("description")).alias("city"),
    )


@query(
    "topic_filter",
    f"""WITH {B5} SELECT o_orderkey, question FROM b5 WHERE lower(question || ' ' || coalesce(slug, '')) LIKE '%temperature%'
    AND regexp_matches(lower(question || ' ' || coalesce(slug, '')), 'paris|london|munich|amsterdam|new york|milan')""",
)
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markets(spark, sf_dir)
    return m.filter(X.is_topic_text(F.col("question"), F.col("slug"))).select("o_orderkey", "question")


@query(
    "detail_targets",
    f"""WITH {TEXT_SQL} SELECT coalesce(condition_id, 'unknown:' || id) AS condition_id, parse_status FROM mk
    WHERE parse_status IN ('resolved', 'partial') ORDER BY 1 LIMIT 25""",
)
def detail_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # targets are picked from the stored market table, not re-derived under a pushed-down filter
    out = materialize(N.normalize_markets(raw_markets(spark, sf_dir)), "markets")
    out = out.select("condition_id", "parse_status")
    return out.filter(F.col("parse_status").isin("resolved", "partial")).orderBy("condition_id").limit(25)


def _list(col: str) -> str:
    return f"CASE WHEN json_valid({col}) THEN from_json({col}, '[\"VARCHAR\"]') ELSE [] END"


SETTLE_SQL = f"""s0 AS (SELECT *, {_list('outcomes')} AS ls, list_transform({_list('outcome_prices')}, lambda x: try_cast(trim(x) AS double)) AS ps0 FROM b5),
s1 AS (SELECT *, CASE WHEN len(list_filter(ps0, lambda x: x IS NULL)) > 0 THEN [] ELSE ps0 END AS ps FROM s0),
s2 AS (SELECT *, CASE WHEN NOT (coalesce(closed, false) OR coalesce(resolved, false)) THEN 'market not closed/resolved; settlement label unavailable'
    WHEN len(ls) < 2 OR len(ps) < 2 THEN 'outcomes/outcomePrices missing or too short for binary settlement'
    WHEN len(ls) <> len(ps) THEN 'outcomes and outcomePrices length mismatch'
    WHEN len(list_filter(ps, lambda x: abs(x - 1) <= 1e-9)) <> 1 OR len(list_filter(ps, lambda x: abs(x) <= 1e-9)) <> len(ps) - 1
      THEN 'outcomePrices not unambiguous binary 1/0 settlement' END AS settle_reason FROM s1),
st AS (SELECT *, CASE WHEN settle_reason IS NULL THEN ls[list_position(list_transform(ps, lambda x: abs(x - 1) <= 1e-9), true)] END AS settle FROM s2)"""


@query("settlement_label", f"WITH {B5}, {SETTLE_SQL} SELECT o_orderkey, settle AS label, settle_reason AS reason FROM st")
def settlement_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markets(spark, sf_dir)
    s = X.settlement_label(F.col("closed"), F.col("resolved"), F.col("outcomes"), F.col("outcome_prices"))
    return m.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.label", "s.reason")


@query(
    "outcomes_explode",
    f"""WITH {B5}, {bucket_sql('b5')}, o AS (SELECT *, {_list('outcomes')} AS ls, {_list('tokens')} AS ts FROM bk),
    x AS (SELECT *, unnest(range(greatest(len(ls), len(ts)))) AS i FROM o),
    y AS (SELECT *, coalesce(ls[i + 1], 'outcome-' || i) AS outcome_label FROM x)
    SELECT condition_id, coalesce(ts[i + 1], concat_ws(':', condition_id, i)) AS token_id, outcome_label, cast(i AS int) AS outcome_index,
      CASE WHEN lower(outcome_label) = 'yes' THEN {CELSIUS.format(x='native_min')} END AS temperature_celsius_min,
      CASE WHEN lower(outcome_label) = 'yes' THEN {CELSIUS.format(x='native_max')} END AS temperature_celsius_max,
      CASE WHEN lower(outcome_label) = 'yes' THEN kind END AS bucket_kind, trim(title) AS group_item_title,
      CASE WHEN lower(outcome_label) = 'yes' THEN unit END AS temperature_unit,
      CASE WHEN lower(outcome_label) = 'yes' THEN native_min END AS temperature_native_min,
      CASE WHEN lower(outcome_label) = 'yes' THEN native_max END AS temperature_native_max FROM y""",
)
def outcomes_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markets(spark, sf_dir)
    return rounded(
        N.explode_outcomes(m, F.col("condition_id"), F.col("outcomes"), F.col("tokens"), F.col("title"))
    )


@query(
    "search_flatten",
    f"""WITH {B5}, doc AS (SELECT *, {DUCK.intdiv('o_orderkey', SEARCH_DOC)} AS payload_id FROM b5),
    alls AS (SELECT payload_id, o_orderkey, id, condition_id, 0 AS src, o_orderkey % 4 AS ev FROM doc WHERE o_orderkey % 4 < 2 UNION ALL
      SELECT payload_id, o_orderkey, id, condition_id, 1, NULL FROM doc WHERE o_orderkey % 4 >= 2 OR o_orderkey % 8 = 0),
    good AS (SELECT alls.*, event_ref FROM alls JOIN b5 USING (o_orderkey) WHERE payload_id % 20 NOT BETWEEN 1 AND 7),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(condition_id, id) ORDER BY src) AS k FROM good) WHERE k = 1)
    SELECT payload_id, id, condition_id, coalesce(event_ref, CASE WHEN src = 0 THEN 'e' || ev || '-' || payload_id END) AS event_id,
      CASE WHEN src = 0 THEN 'slug-' || ev || '-' || payload_id END AS event_slug,
      CASE WHEN src = 0 AND ev = 0 THEN 'neg-' || payload_id END AS neg_risk_market_id FROM one
    UNION ALL SELECT min(payload_id), NULL, '0x1', NULL, NULL, NULL FROM doc WHERE payload_id % 20 = 7
      AND NOT EXISTS (SELECT 1 FROM one WHERE condition_id = '0x1') HAVING count(*) > 0
    UNION ALL SELECT min(payload_id), NULL, NULL, NULL, NULL, NULL FROM doc WHERE payload_id % 20 = 6 HAVING count(*) > 0""",
)
def search_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = N.flatten_search(search_payloads(spark, sf_dir), "payload_id")
    return flat.select(
        "payload_id", "id", F.col("conditionId").alias("condition_id"), F.col("eventId").alias("event_id"),
        "event_slug", F.col("negRiskMarketID").alias("neg_risk_market_id"),
    )


@query(
    "canonical_url",
    """WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS base FROM pages),
    q AS (SELECT *, regexp_extract(base, '^([^?]*)', 1) AS head, regexp_extract(base, '\\?(.*)$', 1) AS qs FROM p)
    SELECT page_id, CASE WHEN qs = '' THEN head ELSE head || '?' || array_to_string(list_sort(list_transform(
      list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') END AS url FROM q""",
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


# ---- routing ------------------------------------------------------------------------------------------

B1 = snapshot_sql()


@query(
    "date_range_filter",
    f"""WITH {B1} SELECT CASE WHEN event_date IS NULL THEN 'undated' WHEN event_date BETWEEN '1996-01-01' AND '1997-12-31' THEN 'in_range'
      ELSE 'outside' END AS route, count(*) AS n FROM (SELECT CASE WHEN raw_weight < 2000 THEN NULL ELSE event_date END AS event_date FROM b1) GROUP BY 1""",
)
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.operators.router import date_route

    rows = snapshots(spark, sf_dir).select(F.when(F.col("raw_weight") >= 2000, F.col("event_date")).alias("event_date"))
    return rows.groupBy(date_route(F.col("event_date"), "1996-01-01", "1997-12-31").alias("route")).agg(
        F.count(F.lit(1)).alias("n")
    )


ROUTE_SQL = f"""{TEXT_SQL}, {SETTLE_SQL}, {bucket_sql('b5')},
rt AS (SELECT mk.o_orderkey, coalesce(mk.condition_id, 'unknown:' || mk.id) AS condition_id, mk.question, CASE
    WHEN NOT (lower(mk.question || ' ' || coalesce(mk.slug, '')) LIKE '%temperature%' AND regexp_matches(lower(mk.question || ' ' || coalesce(mk.slug, '')),
      'paris|london|munich|amsterdam|new york|milan')) THEN 'not a temperature market'
    WHEN mk.event_date IS NULL THEN 'unknown/ambiguous event date'
    WHEN st.settle_reason IS NOT NULL THEN st.settle_reason
    WHEN mk.station_icao IS NULL THEN 'station ICAO missing; unknown station quarantined'
    WHEN substr(mk.station_icao, 4, 1) IN ('D', 'K') THEN 'unknown station ' || mk.station_icao || '; not remapped (e.g. LFPB is not LFPG)'
    WHEN NOT list_contains(list_transform(ls, lambda x: lower(x)), 'yes') THEN 'YES token missing'
    WHEN bk.kind IS NULL THEN 'unknown/ambiguous temperature bucket' END AS reason
  FROM mk JOIN st USING (o_orderkey) JOIN bk USING (o_orderkey))"""


def placed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised markets with their raw settlement fields and station."""
    from bucketwise.plans.bindings import STATION_CODE
    from bucketwise.sources.stations import resolve_stations

    raw = raw_markets(spark, sf_dir)
    market = N.normalize_markets(raw)
    # the record id is unique, so the raw settlement fields meet their market on it
    facts = market.join(
        raw.select(F.col("id").alias("market_id"), "o_orderkey", "resolved", "outcomes", "outcomePrices", "clobTokenIds", "groupItemTitle"),
        "market_id",
    )
    # the dimension lacks some nations' codes, so that their markets meet no station
    code = F.expr(STATION_CODE.format(n="n_nationkey"))
    dim = table(spark, sf_dir, "nation").select(code.alias("station_id")).where("substr(station_id, 4, 1) NOT IN ('D', 'K')")
    return resolve_stations(facts, dim, "station_icao")


@query("reject_router", f"WITH {ROUTE_SQL} SELECT o_orderkey, condition_id, reason, CASE WHEN reason IS NOT NULL THEN question END AS details FROM rt")
def reject_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.operators.router import market_reason

    routed = placed_markets(spark, sf_dir).withColumn("reason", market_reason(known_station=F.col("station_id").isNotNull()))
    return routed.select(
        "o_orderkey", "condition_id", "reason", F.when(F.col("reason").isNotNull(), F.col("question")).alias("details")
    )
