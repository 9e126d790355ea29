"""Snapshot identity, dedupe, event groups, routing and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise import constants as C
from bucketwise.functions.identity import dedup_key, with_identity
from bucketwise.functions.times import iso_utc
from bucketwise.operators import audit, groups
from bucketwise.operators.keyed import first_per_key, split_first_seen
from bucketwise.plans.bindings import (
    SEQ_COLUMNS, SQL_KEY, snapshot_sql, snapshots, snapshots_unique,
)
from bucketwise.plans.registry import query, rounded
from bucketwise.sources.scratch import materialize

KEYS = ["condition_id", "token_id", "event_date", "decision_ts"]
B1 = snapshot_sql()
SEQ_SQL = ", ".join(SEQ_COLUMNS)

SQL_EVIDENCE = """CASE split_part(event_key, chr(1), 1)
    WHEN 'slug_family' THEN 'slug'
    WHEN 'question_family' THEN 'question,city,station_icao,event_date'
    WHEN 'ambiguous' THEN '' ELSE split_part(event_key, chr(1), 1) END"""


@query(
    "dedupe_first_seen",
    f"""WITH {B1} SELECT condition_id, token_id, event_date, dedup_key, raw_weight,
    round(market_probability, 6) AS market_probability FROM b1u""",
)
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = first_per_key(snapshots(spark, sf_dir), KEYS, ["seq"])
    return rounded(
        kept.select(
            "condition_id", "token_id", "event_date",
            dedup_key(*[F.col(k) for k in KEYS]).alias("dedup_key"), "raw_weight",
            "market_probability",
        )
    )


@query(
    "dedupe_quarantine",
    f"""WITH {B1} SELECT 'duplicate_snapshot' AS reason, condition_id, market_id, token_id, city,
    station_icao, event_date, dedup_key AS details FROM b1r WHERE rn > 1""",
)
def dedupe_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _kept, copies = split_first_seen(snapshots(spark, sf_dir), KEYS, ["seq"])
    return groups.quarantine_rows(
        copies, F.lit(C.DUPLICATE_SNAPSHOT), dedup_key(*[F.col(k) for k in KEYS])
    )


@query(
    "canonical_identity",
    f"""WITH {B1} SELECT token_id, replace(event_key, chr(1), '|') AS canonical_event_key,
    split_part(event_key, chr(1), 1) AS source, {SQL_EVIDENCE} AS evidence_fields,
    starts_with(event_key, 'ambiguous') AS ambiguous,
    CASE WHEN starts_with(event_key, 'ambiguous') THEN 'event_identity_ambiguous' END
      AS quarantine_reason, slug_family, question_family,
    CASE WHEN regexp_full_match(upper(trim(station_icao)), '[A-Z]{{4}}')
      THEN upper(trim(station_icao)) END AS station FROM b1k""",
)
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.functions.text import normalize_station, question_family, slug_family

    rows = with_identity(snapshots(spark, sf_dir))
    return rows.select(
        "token_id",
        F.array_join("identity.canonical_event_key", "|").alias("canonical_event_key"),
        F.col("identity.source").alias("source"),
        F.array_join("identity.evidence_fields", ",").alias("evidence_fields"),
        F.col("identity.ambiguous").alias("ambiguous"),
        F.col("identity.quarantine_reason").alias("quarantine_reason"),
        slug_family(F.col("slug")).alias("slug_family"),
        question_family(F.col("question")).alias("question_family"),
        normalize_station(F.col("station_icao")).alias("station"),
    )


# ---- event groups -------------------------------------------------------------------------------

def _distinct(name: str, value: str) -> str:
    return f"count(DISTINCT {value}) AS n_{name}, min({value}) AS v_{name}"


def _norm(x: str) -> str:
    return f"nullif(trim(lower({x})), '')"


def _station(x: str) -> str:
    return f"CASE WHEN regexp_full_match(upper(trim({x})), '[A-Z]{{4}}') THEN upper(trim({x})) END"


WUNDERGROUND = "(?i)/history/daily/(?:[a-z]{2}/[^/]+/)?([A-Za-z]{4})\\b"
TEXT = "coalesce(question, '') || chr(10) || coalesce(slug, '')"
CITY_PATTERN = "(?i)\\b(new\\s+york|paris|london|munich|amsterdam|milan)\\b"
SLUG_DAY = "(?i)-on-([a-z]+)-(\\d{1,2})"
QUESTION_DAY = "(?i)\\bon\\s+([A-Za-z]+)\\s+(\\d{1,2})"


def _day(x: str, pattern: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{pattern}') THEN lower(regexp_extract({x}, '{pattern}', 1)) || '-' "
        f"|| cast(cast(regexp_extract({x}, '{pattern}', 2) AS int) AS varchar) END"
    )


ON_TOPIC = (
    "(lower(coalesce(question, '') || ' ' || coalesce(slug, '')) LIKE '%temperature%' AND regexp_matches("
    "lower(coalesce(question, '') || ' ' || coalesce(slug, '')), 'amsterdam|london|milan|munich|new york|paris'))"
)
OWN_DAY = "lower(strftime(cast(event_date AS date), '%B')) || '-' || day(cast(event_date AS date))"


def group_sql(rows: str) -> str:
    """CTEs gf (facts) and gv (coherence, structure, settlement codes) over a row CTE."""
    return f"""gr AS (SELECT *, {_day('slug', SLUG_DAY)} AS slug_day, {_day('question', QUESTION_DAY)} AS question_day,
  lower(trim(coalesce(bucket_label, ''))) AS label_n, lower(trim(coalesce(bucket_kind, ''))) AS kind_n,
  (question IS NOT NULL OR slug IS NOT NULL) AND NOT {ON_TOPIC} AS off_topic,
  CASE WHEN lower(provenance_urls[2]) LIKE '%wunderground.com%' THEN lower(rtrim(provenance_urls[2], '.')) END AS res_url,
  nullif(upper(regexp_extract(provenance_urls[2], '{WUNDERGROUND}', 1)), '') AS res_icao
  FROM {rows}),
gc AS (SELECT event_key, count(DISTINCT c) AS n_text_city, min(c) AS v_text_city FROM (
  SELECT event_key, regexp_replace(lower(unnest(regexp_extract_all({TEXT}, '{CITY_PATTERN}', 1))), '\\s+', ' ', 'g') AS c
  FROM gr) GROUP BY 1),
gd AS (SELECT event_key, count(DISTINCT d) AS n_day, min(d) AS v_day FROM (
  SELECT event_key, slug_day AS d FROM gr WHERE slug_day IS NOT NULL UNION ALL
  SELECT event_key, question_day FROM gr WHERE question_day IS NOT NULL) GROUP BY 1),
gf AS (SELECT event_key, count(*) AS n,
  {_distinct('event_id', _norm('event_id'))}, {_distinct('city', _norm('city'))},
  {_distinct('station', _station('station_icao'))}, {_distinct('date', "nullif(event_date, '')")},
  {_distinct('unit', _norm('temperature_unit'))}, {_distinct('res_station', _station('source_station_icao'))},
  {_distinct('res_url', 'res_url')}, {_distinct('res_icao', 'res_icao')},
  {_distinct('event_slug', _norm('event_slug'))}, {_distinct('neg', _norm('neg_risk_market_id'))},
  {_distinct('slug_family', 'slug_family')}, {_distinct('question_family', 'question_family')},
  {_distinct('slug_day', 'slug_day')}, min({OWN_DAY}) AS own_day, bool_or(off_topic) AS off_topic,
  bool_or(starts_with(event_key, 'ambiguous')) AS ambiguous, bool_or(label_n = '') AS blank_label,
  count(DISTINCT label_n) AS n_labels, bool_or(kind_n IN ('', 'unknown')) AS blank_kind,
  bool_or(kind_n IN ('exact', 'range', 'above', 'below')) AS temp_kind,
  bool_or(kind_n NOT IN ('exact', 'range', 'above', 'below')) AS other_kind,
  count(*) FILTER (lower(settlement_label) = 'yes') AS n_yes, count(settlement_label) AS n_labelled
  FROM gr GROUP BY 1),
gw AS (SELECT gf.*, n_text_city, v_text_city, n_day, v_day,
  coalesce(n_text_city > 1, false) OR coalesce(v_text_city <> v_city, false) OR off_topic AS weak_base,
  coalesce(n_slug_day > 1, false) OR coalesce(v_slug_day <> own_day, false) AS weak_slug,
  coalesce(n_day > 1, false) OR coalesce(v_day <> own_day, false) AS weak_question
  FROM gf LEFT JOIN gc USING (event_key) LEFT JOIN gd USING (event_key)),
gv AS (SELECT *, n_slug_family > 1 AND (weak_base OR weak_slug) AS slug_conflict,
  n_question_family > 1 AND (weak_base OR weak_question) AS question_conflict,
  CASE WHEN ambiguous THEN 'event_identity_ambiguous' WHEN n_event_id > 1 THEN 'event_id_conflict'
    WHEN n_city > 1 THEN 'event_city_conflict' WHEN n_station > 1 THEN 'event_station_conflict'
    WHEN n_date > 1 THEN 'event_date_conflict' WHEN n_unit > 1 THEN 'event_unit_conflict'
    WHEN n_res_station > 1 OR n_res_url > 1 OR n_res_icao > 1 OR v_res_station <> v_res_icao
      THEN 'event_resolution_source_conflict'
    WHEN n_event_slug > 1 THEN 'event_slug_family_conflict' WHEN n_neg > 1 THEN 'event_market_family_conflict'
    WHEN n_slug_family > 1 AND (weak_base OR weak_slug) THEN 'event_slug_family_conflict'
    WHEN n_question_family > 1 AND (weak_base OR weak_question) THEN 'event_question_family_conflict'
    END AS coherence_code,
  CASE WHEN blank_label THEN 'event_bucket_structure_conflict' WHEN n_labels < n THEN 'duplicate_outcome_conflict'
    WHEN blank_kind OR (temp_kind AND other_kind) THEN 'event_bucket_structure_conflict' END AS structure_code,
  CASE WHEN n_yes > 1 THEN 'event_settlement_cardinality_conflict'
    WHEN n_labelled = n AND n_yes = 0 THEN 'event_settlement_unresolved' END AS settlement_code
  FROM gw)"""


def topology_sql(rows: str) -> str:
    """CTE gt (event_key, topology_detail) over a row CTE."""
    return f"""t0 AS (SELECT event_key, token_id, lower(trim(bucket_kind)) AS kind, temperature_native_min AS lo,
  temperature_native_max AS hi, {_norm('temperature_unit')} AS unit, {SEQ_SQL} FROM {rows}
  WHERE lower(trim(bucket_kind)) IN ('exact', 'range', 'above', 'below')),
t1 AS (SELECT *, coalesce(CASE kind WHEN 'exact' THEN lo = hi WHEN 'range' THEN lo <= hi
  WHEN 'below' THEN hi IS NOT NULL AND lo IS NULL ELSE lo IS NOT NULL AND hi IS NULL END, false) AS fits,
  count(*) OVER (PARTITION BY event_key, kind, lo, hi) AS copies FROM t0),
t2 AS (SELECT event_key, min(unit) AS unit, count(DISTINCT unit) AS n_unit, max(copies) AS copies,
  first('invalid_native_bounds:token=' || token_id || ';kind=' || kind || ';native_min='
    || coalesce(cast(lo AS varchar), 'None') || ';native_max=' || coalesce(cast(hi AS varchar), 'None')
    ORDER BY {SEQ_SQL}) FILTER (NOT fits) AS bad,
  count(DISTINCT hi) FILTER (kind = 'below') AS n_below, count(DISTINCT lo) FILTER (kind = 'above') AS n_above,
  max(hi) FILTER (kind = 'below') AS below_hi, min(lo) FILTER (kind = 'above') AS above_lo FROM t1 GROUP BY 1),
t3 AS (SELECT *, CASE WHEN n_unit > 1 THEN 'native_unit_mismatch' WHEN bad IS NOT NULL THEN bad
  WHEN copies > 1 THEN 'duplicate_semantic_coverage' WHEN n_below > 1 OR n_above > 1
  THEN 'invalid_tail:multiple_open_ends' END AS early, coalesce(unit, 'c') = 'f' AS is_f FROM t2),
t4 AS (SELECT t1.event_key, t1.token_id, t1.lo, t1.hi, is_f, row_number() OVER w AS rn,
  lag(t1.token_id) OVER w AS p_token, lag(t1.lo) OVER w AS p_lo, lag(t1.hi) OVER w AS p_hi
  FROM t1 JOIN t3 USING (event_key) WHERE early IS NULL AND kind IN ('exact', 'range')
  WINDOW w AS (PARTITION BY t1.event_key ORDER BY t1.lo, t1.hi, t1.token_id)),
t5 AS (SELECT *, CASE WHEN is_f THEN cast(cast(round(p_lo) AS bigint) AS varchar) || '-' || cast(cast(round(p_hi) AS bigint) AS varchar)
    || ',' || cast(cast(round(lo) AS bigint) AS varchar) || '-' || cast(cast(round(hi) AS bigint) AS varchar)
  ELSE cast(p_lo AS varchar) || '-' || cast(p_hi AS varchar) || ',' || cast(lo AS varchar) || '-' || cast(hi AS varchar) END AS spans,
  CASE WHEN is_f THEN ';spans=' ELSE ';native=' END AS word FROM t4),
t6 AS (SELECT event_key, first(CASE WHEN lo <= p_hi THEN 'overlap' ELSE 'gap' END || ':tokens=' || p_token || ',' || token_id
    || word || spans ORDER BY rn) FILTER (p_hi IS NOT NULL AND lo <> p_hi + 1) AS fault,
  min(lo) AS first_lo, first(hi ORDER BY rn DESC) AS last_hi FROM t5 GROUP BY 1),
t7 AS (SELECT event_key, early, fault, first_lo, last_hi, below_hi, above_lo,
  CASE WHEN is_f THEN cast(cast(first_lo AS bigint) AS varchar) ELSE cast(first_lo AS varchar) END AS first_t,
  CASE WHEN is_f THEN cast(cast(last_hi AS bigint) AS varchar) ELSE cast(last_hi AS varchar) END AS last_t,
  CASE WHEN is_f THEN cast(cast(below_hi AS bigint) AS varchar) ELSE cast(below_hi AS varchar) END AS below_t,
  CASE WHEN is_f THEN cast(cast(above_lo AS bigint) AS varchar) ELSE cast(above_lo AS varchar) END AS above_t
  FROM t3 LEFT JOIN t6 USING (event_key)),
gt AS (SELECT event_key, CASE WHEN early IS NOT NULL THEN early WHEN fault IS NOT NULL THEN fault
  WHEN first_lo <> below_hi + 1 THEN 'invalid_tail:low;below_hi=' || below_t || ';first_interior_lo=' || first_t
  WHEN first_lo IS NULL AND above_lo <> below_hi + 1 THEN 'invalid_tail:low_high_connect;below_hi=' || below_t || ';above_lo=' || above_t
  WHEN above_lo <> last_hi + 1 THEN 'invalid_tail:high;above_lo=' || above_t || ';last_interior_hi=' || last_t
  END AS topology_detail FROM t7)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verdicts read of the unique snapshots; written once, so the dedupe's shuffles are over before the facts' begin."""
    return materialize(snapshots_unique(spark, sf_dir).select(*groups.VERDICT_COLUMNS), "grouped")


@query(
    "group_conflicts",
    f"""WITH {B1}, {group_sql('b1u')} SELECT replace(event_key, chr(1), '|') AS event_key, n, coherence_code,
    structure_code, settlement_code, n_yes, n_labelled FROM gv""",
)
def group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = groups.group_facts(_grouped(spark, sf_dir))
    return facts.select(
        F.replace("event_key", F.lit("\u0001"), F.lit("|")).alias("event_key"), "n",
        groups.coherence_code().alias("coherence_code"),
        groups.structure_code().alias("structure_code"),
        groups.settlement_code().alias("settlement_code"), "n_yes", "n_labelled",
    )


@query(
    "group_weak_evidence",
    f"""WITH {B1}, {group_sql('b1u')} SELECT replace(event_key, chr(1), '|') AS event_key, slug_conflict,
    question_conflict, off_topic, v_text_city AS text_city, v_slug_day AS slug_day, v_res_url AS resolution_url,
    v_res_icao AS resolution_station FROM gv""",
)
def group_weak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = groups.group_facts(_grouped(spark, sf_dir))
    return facts.select(
        F.replace("event_key", F.lit("\u0001"), F.lit("|")).alias("event_key"),
        *[c.alias(n) for n, c in groups.weak_evidence().items()],
        "off_topic", F.col("text_city_min").alias("text_city"), F.col("slug_day_min").alias("slug_day"),
        F.col("res_url_min").alias("resolution_url"), F.col("res_icao_min").alias("resolution_station"),
    )


@query(
    "ladder_topology",
    f"""WITH {B1}, {topology_sql('b1u')} SELECT replace(event_key, chr(1), '|') AS event_key, topology_detail FROM gt""",
)
def ladder_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups.ladder_topology(snapshots_unique(spark, sf_dir), ["seq"])
    return out.withColumn("event_key", F.replace("event_key", F.lit("\u0001"), F.lit("|")))


# what acceptance reads; features and prices stay out of the shuffles
GROUP_COLUMNS = (
    "condition_id", "market_id", "token_id", "event_id", "neg_risk_market_id", "event_slug", "slug",
    "question", "city", "station_icao", "source_station_icao", "event_date", "decision_ts",
    "bucket_label", "bucket_kind", "temperature_unit", "temperature_native_min",
    "temperature_native_max", "settlement_label", "provenance_urls", "raw_paths", "content_hashes",
    "seq", "raw_weight",
)


def _for_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select(*GROUP_COLUMNS)


ACCEPT_SQL = f"""{B1},
ba AS (SELECT *, row_number() OVER (PARTITION BY event_key, dedup_key ORDER BY {SEQ_SQL}) AS copy FROM b1k),
bc AS (SELECT * FROM ba WHERE copy = 1 AND NOT starts_with(event_key, 'ambiguous')),
{group_sql('bc')}, {topology_sql('bc')},
verdict AS (SELECT gv.event_key, coalesce(coherence_code, structure_code,
    CASE WHEN topology_detail IS NOT NULL THEN 'event_bucket_structure_conflict' END, settlement_code) AS code,
  CASE WHEN coherence_code IS NOT NULL OR structure_code IS NOT NULL THEN
    CASE coherence_code WHEN 'event_id_conflict' THEN 'event_id' WHEN 'event_city_conflict' THEN 'city'
      WHEN 'event_station_conflict' THEN 'station_icao' WHEN 'event_date_conflict' THEN 'event_date'
      WHEN 'event_unit_conflict' THEN 'temperature_unit' END
    ELSE topology_detail END AS detail FROM gv LEFT JOIN gt USING (event_key)),
routed AS (SELECT ba.*, CASE WHEN starts_with(ba.event_key, 'ambiguous') THEN 'event_identity_ambiguous'
    WHEN copy > 1 THEN 'duplicate_snapshot' ELSE verdict.code END AS code,
  CASE WHEN starts_with(ba.event_key, 'ambiguous') THEN NULL WHEN copy > 1 THEN dedup_key
    ELSE verdict.detail END AS detail FROM ba LEFT JOIN verdict USING (event_key))"""


@query(
    "group_acceptance",
    f"""WITH {ACCEPT_SQL} SELECT token_id, condition_id, event_date, raw_weight,
    code IS NULL AS accepted, code FROM routed""",
)
def group_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = groups.route_event_groups(_for_groups(spark, sf_dir), ["seq"])
    return routed.select(
        "token_id", "condition_id", "event_date", "raw_weight",
        F.col("_code").isNull().alias("accepted"), F.col("_code").alias("code"),
    )


@query(
    "group_quarantine",
    f"""WITH {ACCEPT_SQL} SELECT code AS reason, condition_id, market_id, token_id, city, station_icao, event_date,
    concat_ws('; ', detail, 'urls=[''' || array_to_string(provenance_urls, ''', ''') || ''']; raw_paths=['''
    || array_to_string(raw_paths, ''', ''') || ''']; hashes=[''' || array_to_string(content_hashes, ''', ''') || ''']')
    AS details FROM routed WHERE code IS NOT NULL""",
)
def group_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.accept_event_groups(_for_groups(spark, sf_dir), ["seq"])[1]


# ---- audit ------------------------------------------------------------------------------------------

@query(
    "audit_totals",
    f"WITH {B1} SELECT count(DISTINCT condition_id) AS markets, count(*) AS snapshots FROM b1",
)
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(snapshots(spark, sf_dir))


@query(
    "audit_missing",
    f"WITH {B1} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS missing FROM b1" for f in C.AUDITED_FIELDS
    ),
)
def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_fields(snapshots(spark, sf_dir))


@query(
    "audit_coverage",
    f"""WITH {B1} SELECT 'city' AS dimension, coalesce(nullif(city, ''), 'unknown') AS value, count(*) AS n FROM b1 GROUP BY ALL
    UNION ALL SELECT 'station_icao', coalesce(nullif(station_icao, ''), 'unknown'), count(*) FROM b1 GROUP BY ALL
    UNION ALL SELECT 'event_date', event_date, count(*) FROM b1 GROUP BY ALL""",
)
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(snapshots(spark, sf_dir))


@query(
    "audit_duplicates",
    f"""WITH {B1} SELECT count(*) AS duplicates FROM (SELECT dedup_key FROM b1k GROUP BY 1 HAVING count(*) > 1)""",
)
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(snapshots(spark, sf_dir))


@query(
    "audit_violations",
    f"""WITH {B1}, v AS (
    SELECT token_id, 'available_at after decision' AS kind FROM b1 WHERE weather_available_at > decision_ts UNION ALL
    SELECT token_id, 'issued_at after decision' FROM b1 WHERE weather_issued_at > decision_ts UNION ALL
    SELECT token_id, 'observation after decision' FROM b1 WHERE observation_as_of > decision_ts UNION ALL
    SELECT token_id, 'market_price_observed_at after decision' FROM b1 WHERE market_price_observed_at > decision_ts UNION ALL
    SELECT token_id, 'unexpected executable price from price-history-only sources' FROM b1
      WHERE best_ask IS NOT NULL OR executable_entry_price IS NOT NULL)
    SELECT token_id || ': ' || kind AS violation FROM v""",
)
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.timestamp_violations(snapshots(spark, sf_dir))


@query(
    "quarantine_histogram",
    f"WITH {ACCEPT_SQL} SELECT code AS reason, count(*) AS n FROM routed WHERE code IS NOT NULL GROUP BY 1",
)
def quarantine_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = groups.route_event_groups(_for_groups(spark, sf_dir), ["seq"])
    return audit.reason_histogram(
        routed.filter("_code IS NOT NULL").select(F.col("_code").alias("reason"))
    )


@query(
    "manifest",
    f"""WITH {B1} SELECT '1995-01-01' AS start_date, count(*) FILTER (rn = 1) AS snapshots_written,
    count(*) FILTER (rn = 1 AND market_probability IS NULL) AS null_market_probability,
    array_to_string(list_sort(list(DISTINCT event_date) FILTER (rn = 1)), ',') AS usable_event_dates,
    count(*) FILTER (rn > 1) AS quarantined FROM b1r""",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, copies = split_first_seen(snapshots(spark, sf_dir), KEYS, ["seq"])
    out = audit.manifest(kept, copies, {"start_date": "1995-01-01"})
    return out.withColumn("usable_event_dates", F.array_join("usable_event_dates", ","))


@query(
    "outcome_router",
    f"""WITH {B1}, w AS (SELECT token_id, raw_weight, CASE WHEN forecast_daily_max_c IS NULL THEN 'NO_USABLE_EVENT_COVERAGE'
      WHEN starts_with(event_key, 'ambiguous') THEN 'event_identity_ambiguous'
      WHEN weather_issued_at > decision_ts THEN 'lookahead rejected: weather issued_at is after decision_ts'
      WHEN weather_available_at > decision_ts THEN 'lookahead rejected: weather available_at is after decision_ts; run not yet public'
      WHEN weather_available_at < weather_issued_at THEN 'lookahead rejected: weather available_at precedes issued_at'
      WHEN market_price_observed_at > decision_ts THEN 'lookahead rejected: price observed_at is after decision_ts'
      WHEN observation_as_of > decision_ts THEN 'lookahead rejected: observation_as_of is after decision_ts'
      WHEN observation_max_so_far_c IS NOT NULL AND observation_as_of IS NULL
        THEN 'lookahead rejected: observation_max_so_far_c requires observation_as_of <= decision_ts' END AS reason FROM b1k)
    SELECT * FROM w""",
)
def outcome_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.operators.router import outcome_reason

    rows = with_identity(snapshots(spark, sf_dir)).withColumn(
        "weather_reject", F.when(F.col("forecast_daily_max_c").isNull(), "NO_USABLE_EVENT_COVERAGE")
    )
    return rows.select("token_id", "raw_weight", outcome_reason().alias("reason"))
