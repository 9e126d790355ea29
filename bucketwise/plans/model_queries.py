"""Split, models, scoring and breakdowns on snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise import constants as C
from bucketwise.functions import classify as M
from bucketwise.functions.times import month_of
from bucketwise.operators import breakdowns as D, groups, metrics, models
from bucketwise.plans.bindings import (
    snapshot_sql, snapshots, snapshots_scored, snapshots_unique, table,
)
from bucketwise.plans.registry import means, query, rounded
from bucketwise.plans.snapshot_queries import ACCEPT_SQL, GROUP_COLUMNS
from bucketwise.sources.scratch import materialize, settle

B1 = snapshot_sql()
SHOWN_KEY = "replace(event_key, chr(1), '|') AS event_key"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("event_key", F.replace("event_key", F.lit("\u0001"), F.lit("|")))


# ---- split ------------------------------------------------------------------------------------------

def split_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT event_date, CASE WHEN rn <= nt THEN 'train'
      WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, cast(floor(n * 0.6::DOUBLE) AS bigint) AS nt, cast(floor(n * 0.2::DOUBLE) AS bigint) AS nv FROM
      (SELECT event_date, row_number() OVER (ORDER BY event_date) AS rn, count(*) OVER () AS n
       FROM (SELECT DISTINCT event_date FROM {source}))))"""


@query(
    "split_dates",
    f"""WITH od AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders), {split_sql('sp', 'od')}
    SELECT event_date, split FROM sp""",
)
def split_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"))
    return models.split_dates(orders)


MODEL_COLUMNS = (
    "event_key", "condition_id", "token_id", "event_date", "city", "station_icao", "bucket_label",
    "bucket_kind", "temperature_unit", "temperature_native_min", "temperature_native_max",
    "temperature_celsius_min", "temperature_celsius_max", "forecast_daily_max_c",
    "diagnostic_actual_max_c", "settlement_label", "market_probability", "forecast_lead_hours",
    "best_ask",
)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique snapshots with their split; events are kept apart per split.

    Written once: fits, predictions and tables all read these rows.
    """
    return _split(materialize(snapshots_unique(spark, sf_dir).select(*MODEL_COLUMNS), "snapshots"))


def _split(rows: DataFrame) -> DataFrame:
    dates = materialize(models.split_dates(rows), "split-dates")
    tagged = models.with_split(rows, dates)
    return tagged.withColumn("event_key", F.concat_ws("\u0001", "split", "event_key"))


EV_SQL = f"""{B1}, {split_sql('sp', 'b1u')},
ev AS (SELECT b1u.* EXCLUDE (event_key), split, split || chr(1) || event_key AS event_key
  FROM b1u JOIN sp USING (event_date))"""


@query("split_counts", f"WITH {EV_SQL} SELECT split, count(*) AS n FROM ev GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_rows",
    f"""WITH {B1} SELECT token_id, station_icao, city, event_date, forecast_daily_max_c, round(dew_point_c, 6) AS dew_point_c,
    round(humidity_pct, 6) AS humidity_pct, cloud_cover_pct, round(wind_speed, 6) AS wind_speed,
    round(observation_max_so_far_c, 6) AS observation_max_so_far_c, forecast_lead_hours,
    cast(substr(event_date, 6, 2) AS int) AS month FROM b1""",
)
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.feature_rows(snapshots(spark, sf_dir)))


# ---- frequency model ----------------------------------------------------------------------------------

FREQ_SQL = f"""{EV_SQL},
wins AS (SELECT * FROM (SELECT event_date, nullif(station_icao, '') AS station, nullif(city, '') AS city,
    cast(substr(event_date, 6, 2) AS int) AS month, coalesce(bucket_label, '') AS label,
    row_number() OVER (PARTITION BY event_date, station_icao, coalesce(bucket_label, '')
      ORDER BY token_id, event_date, condition_id) AS k
  FROM ev WHERE split = 'train' AND lower(settlement_label) = 'yes') WHERE k = 1),
ff AS (SELECT 'station_month' AS level, station, month, NULL AS city, label, count(*) AS n FROM wins
    WHERE station IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'station', station, NULL, NULL, label, count(*) FROM wins WHERE station IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'city', NULL, NULL, city, label, count(*) FROM wins WHERE city IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'global', NULL, NULL, NULL, label, count(*) FROM wins GROUP BY ALL)"""

FREQ_PREDICT_SQL = f"""{FREQ_SQL},
target AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY token_id, event_date, condition_id) AS pos
  FROM ev WHERE split <> 'train'),
lv AS (SELECT event_key, station_icao AS station, city, cast(substr(event_date, 6, 2) AS int) AS month,
    CASE WHEN EXISTS (SELECT 1 FROM ff WHERE level = 'station_month' AND ff.station = h.station_icao
        AND ff.month = cast(substr(h.event_date, 6, 2) AS int)) THEN 'station_month'
      WHEN EXISTS (SELECT 1 FROM ff WHERE level = 'station' AND ff.station = h.station_icao) THEN 'station'
      WHEN EXISTS (SELECT 1 FROM ff WHERE level = 'city' AND ff.city = h.city) THEN 'city' ELSE 'global' END AS level
  FROM target h WHERE pos = 1),
fw AS (SELECT t.event_key, t.token_id, t.event_date, t.condition_id, coalesce(nullif(t.bucket_label, ''), 'bucket-' || (t.pos - 1)) AS label,
    CASE WHEN t.bucket_label <> '' THEN coalesce(f.n, 0) ELSE 0 END AS w
  FROM target t JOIN lv USING (event_key) LEFT JOIN ff f ON f.level = lv.level AND f.label = t.bucket_label
    AND (lv.level NOT IN ('station_month', 'station') OR f.station = lv.station)
    AND (lv.level <> 'station_month' OR f.month = lv.month) AND (lv.level <> 'city' OR f.city = lv.city)),
fp AS (SELECT event_key, token_id, label, probability FROM (SELECT *, CASE WHEN sum(w) OVER e > 0 THEN w / sum(w) OVER e
    ELSE 1.0 / count(*) OVER e END AS probability, row_number() OVER (PARTITION BY event_key, token_id
    ORDER BY event_date DESC, condition_id DESC) AS last FROM fw WINDOW e AS (PARTITION BY event_key)) WHERE last = 1)"""


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'train'")


def _target(rows: DataFrame) -> DataFrame:
    return rows.filter("split <> 'train'")


@query("freq_fit", f"WITH {FREQ_SQL} SELECT * FROM ff")
def freq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_frequency(_train(split_rows(spark, sf_dir)))


@query(
    "freq_predict",
    f"WITH {FREQ_PREDICT_SQL} SELECT {SHOWN_KEY}, token_id, label, round(probability, 6) AS probability FROM fp",
)
def freq_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    fit = materialize(models.fit_frequency(_train(rows)), "fit")
    return shown(rounded(models.predict_frequency(_target(rows), fit)))


# ---- forecast-error model --------------------------------------------------------------------------------

ERROR_SQL = f"""{EV_SQL},
ee AS (SELECT * FROM (SELECT nullif(station_icao, '') AS station, diagnostic_actual_max_c - forecast_daily_max_c AS error,
    row_number() OVER (PARTITION BY event_date, station_icao ORDER BY token_id, event_date, condition_id) AS k
  FROM ev WHERE split = 'train' AND diagnostic_actual_max_c IS NOT NULL AND forecast_daily_max_c IS NOT NULL) WHERE k = 1),
ef AS (SELECT station, error, count(*) AS n FROM ee WHERE station IS NOT NULL GROUP BY ALL
  UNION ALL SELECT NULL, error, count(*) FROM ee GROUP BY ALL)"""

DEGREE = "CASE WHEN {v} >= 0 THEN floor({v} + 0.5::DOUBLE) ELSE ceil({v} - 0.5::DOUBLE) END"


def ladder_sql(rows: str) -> str:
    """CTE ld: event rows with unit and the bounds that count for it."""
    return f"""lu AS (SELECT event_key, CASE WHEN count(DISTINCT temperature_unit) = 1 THEN min(temperature_unit)
      WHEN count(DISTINCT u) = 1 THEN min(u) END AS unit FROM (SELECT *,
      nullif(regexp_extract(bucket_label, '°\\s*([CF])\\b', 1), '') AS u FROM {rows}) GROUP BY 1),
ln AS (SELECT r.event_key, token_id, event_date, condition_id, bucket_kind AS kind, coalesce(unit, 'C') = 'F' AS is_f,
    temperature_celsius_min AS c_lo, temperature_celsius_max AS c_hi, temperature_native_min AS n_lo, temperature_native_max AS n_hi,
    cast(nullif(regexp_extract(bucket_label, '([+-]?\\d+)\\s*[-–]\\s*([+-]?\\d+)', 1), '') AS double) AS r_lo,
    cast(nullif(regexp_extract(bucket_label, '([+-]?\\d+)\\s*[-–]\\s*([+-]?\\d+)', 2), '') AS double) AS r_hi,
    cast(nullif(regexp_extract(bucket_label, '([+-]?\\d+)', 1), '') AS double) AS one
  FROM {rows} r JOIN lu USING (event_key)),
ld AS (SELECT event_key, token_id, event_date, condition_id, is_f,
    CASE kind WHEN 'exact' THEN 0 WHEN 'range' THEN 1 WHEN 'below' THEN 2 WHEN 'above' THEN 3 END AS prio,
    CASE WHEN NOT is_f THEN c_lo WHEN n_lo IS NOT NULL OR n_hi IS NOT NULL THEN n_lo WHEN r_lo IS NOT NULL THEN r_lo
      WHEN kind <> 'below' THEN one END AS lo,
    CASE WHEN NOT is_f THEN c_hi WHEN n_lo IS NOT NULL OR n_hi IS NOT NULL THEN n_hi WHEN r_lo IS NOT NULL THEN r_hi
      WHEN kind <> 'above' THEN one END AS hi FROM ln)"""


def fits_sql(v: str) -> str:
    deg = DEGREE.format(v=f"({v} * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE)")
    x = f"(CASE WHEN is_f THEN {deg} ELSE {v} END)"
    return (
        f"CASE prio WHEN 0 THEN CASE WHEN is_f THEN {deg} = {DEGREE.format(v='lo')} ELSE abs({v} - lo) < 0.5 END "
        f"WHEN 1 THEN lo <= {x} AND {x} <= hi WHEN 2 THEN {x} <= hi WHEN 3 THEN {x} >= lo END"
    )


ERROR_PREDICT_SQL = f"""{ERROR_SQL},
target AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY token_id, event_date, condition_id) AS pos
  FROM ev WHERE split <> 'train'),
{ladder_sql('target')},
hd AS (SELECT event_key, forecast_daily_max_c AS forecast, CASE WHEN station_icao IN (SELECT station FROM ef
    WHERE station IS NOT NULL) THEN station_icao ELSE '*' END AS src FROM target WHERE pos = 1),
iv AS (SELECT event_key, forecast + error AS v, sum(n) AS n FROM hd JOIN ef ON coalesce(ef.station, '*') = hd.src
  WHERE forecast IS NOT NULL GROUP BY ALL),
hit AS (SELECT event_key, v, any_value(n) AS n, unnest(arg_min({{'token_id': token_id, 'event_date': event_date,
    'condition_id': condition_id}}, (prio, token_id, event_date, condition_id)))
  FROM iv JOIN ld USING (event_key) WHERE {fits_sql('v')} GROUP BY event_key, v),
ew AS (SELECT t.event_key, t.token_id, t.event_date, t.condition_id, coalesce(nullif(t.bucket_label, ''), 'bucket-' || (t.pos - 1)) AS label,
    coalesce(h.w, 0) AS w FROM target t LEFT JOIN (SELECT event_key, token_id, event_date, condition_id, sum(n) AS w
    FROM hit GROUP BY ALL) h USING (event_key, token_id, event_date, condition_id)),
ep AS (SELECT event_key, token_id, label, probability FROM (SELECT *, CASE WHEN sum(w) OVER e > 0
    THEN cast(w AS double) / sum(w) OVER e ELSE 1.0 / count(*) OVER e END AS probability, row_number() OVER (
    PARTITION BY event_key, token_id ORDER BY event_date DESC, condition_id DESC) AS last
    FROM ew WINDOW e AS (PARTITION BY event_key)) WHERE last = 1)"""


@query("error_fit", f"WITH {ERROR_SQL} SELECT station, error, n FROM ef")
def error_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_errors(_train(split_rows(spark, sf_dir)))


@query(
    "error_predict",
    f"WITH {ERROR_PREDICT_SQL} SELECT {SHOWN_KEY}, token_id, label, round(probability, 6) AS probability FROM ep",
)
def error_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    fit = materialize(models.fit_errors(_train(rows)), "fit")
    return shown(rounded(models.predict_errors(_target(rows), fit)))


@query(
    "ladder_match",
    f"""WITH {B1}, {ladder_sql('b1u')}, vals AS (SELECT DISTINCT event_key, diagnostic_actual_max_c AS value FROM b1u
      WHERE diagnostic_actual_max_c IS NOT NULL),
    hit AS (SELECT event_key, value, arg_min(token_id, (prio, token_id, event_date, condition_id)) AS token_id
      FROM vals JOIN ld USING (event_key) WHERE {fits_sql('value')} GROUP BY ALL)
    SELECT replace(event_key, chr(1), '|') AS event_key, value, token_id FROM vals LEFT JOIN hit USING (event_key, value)""",
)
def ladder_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(snapshots_unique(spark, sf_dir).select(*MODEL_COLUMNS), "snapshots")
    values = (
        rows.filter("diagnostic_actual_max_c IS NOT NULL")
        .select("event_key", F.col("diagnostic_actual_max_c").alias("value"))
        .distinct()
    )
    return shown(models.match_values(values, models.ladder_rungs(rows)).select("event_key", "value", "token_id"))


# ---- scoring ----------------------------------------------------------------------------------------------

SCORED_SQL = f"""{B1}, sc AS (SELECT *, CASE WHEN l_linenumber_zero THEN NULL ELSE model_p END AS mp,
    1.0::DOUBLE / count(*) OVER (PARTITION BY event_key) AS bp FROM
    (SELECT *, raw_weight < 1500 AS l_linenumber_zero FROM b1m)),
lab AS (SELECT *, CASE WHEN lower(settlement_label) = 'yes' THEN 1 ELSE 0 END AS y FROM sc WHERE settlement_label IS NOT NULL),
pe AS (SELECT event_key, count(*) AS n, sum(y) AS n_yes, count(*) FILTER (mp IS NULL OR bp IS NULL) AS n_missing,
    coalesce(bool_and(mp >= -1e-9) AND abs(sum(mp) - 1) <= 1e-9, false) AS m_ok,
    coalesce(bool_and(bp >= -1e-9) AND abs(sum(bp) - 1) <= 1e-9, false) AS b_ok,
    sum((mp - y) ** 2) AS m_brier, sum((bp - y) ** 2) AS b_brier,
    sum(-ln(least(1 - 1e-15, greatest(1e-15, mp)))) FILTER (y = 1) AS m_log,
    sum(-ln(least(1 - 1e-15, greatest(1e-15, bp)))) FILTER (y = 1) AS b_log FROM lab GROUP BY 1),
sk AS (SELECT *, CASE WHEN n_yes = 0 THEN 'zero YES winners' WHEN n_yes > 1 THEN 'multiple YES winners'
    WHEN n_missing > 0 THEN 'missing model or baseline probabilities'
    WHEN NOT m_ok OR NOT b_ok THEN 'probabilities missing or not normalized' END AS skip FROM pe),
kept AS (SELECT lab.* FROM lab JOIN sk USING (event_key) WHERE skip IS NULL)"""


def ece_sql(rows: str, p: str) -> str:
    return (
        f"(SELECT sum(n * abs(ap - ay)) / sum(n) FROM (SELECT count(*) AS n, avg({p}) AS ap, avg(y) AS ay FROM {rows} "
        f"GROUP BY least(9, greatest(0, cast(trunc({p} * 10) AS int)))))"
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique snapshots with a model probability (missing for the lightest rows) and a uniform one."""
    rows = snapshots_scored(spark, sf_dir)
    sizes = rows.groupBy("event_key").agg((F.lit(1.0) / F.count(F.lit(1))).alias("bp"))
    return rows.join(sizes, "event_key").withColumn(
        "mp", F.when(F.col("raw_weight") >= 1500, F.col("model_p"))
    )


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_rows(spark, sf_dir)
    scores = metrics.event_scores(rows, "event_key", "mp", "bp").filter("skip_reason IS NULL")
    return (
        rows.filter("settlement_label IS NOT NULL")
        .join(scores.select("event_key"), "event_key", "left_semi")
        .withColumn("y", M.is_yes(F.col("settlement_label")).cast("int"))
    )


@query(
    "score_split",
    f"""WITH {SCORED_SQL} SELECT CASE WHEN count(*) FILTER (skip IS NULL) > 0 THEN 'ok' ELSE 'insufficient_data' END AS status,
    cast(NULL AS varchar) AS reason, cast(sum(n) AS bigint) AS n, count(*) AS events, count(*) FILTER (skip IS NULL) AS scored_events,
    count(*) FILTER (skip IS NOT NULL) AS skipped_events, round(avg(m_brier) FILTER (skip IS NULL), 6) AS model_brier,
    round(avg(m_log) FILTER (skip IS NULL), 6) AS model_log_loss, round(avg(b_brier) FILTER (skip IS NULL), 6) AS baseline_brier,
    round(avg(b_log) FILTER (skip IS NULL), 6) AS baseline_log_loss, bool_and(m_ok) FILTER (skip IS NULL) AS model_sum_ok,
    bool_and(b_ok) FILTER (skip IS NULL) AS baseline_sum_ok,
    (SELECT string_agg(skip || ' (' || c || ')', ', ' ORDER BY skip || ' (' || c || ')') FROM
      (SELECT skip, count(*) AS c FROM sk WHERE skip IS NOT NULL GROUP BY 1)) AS skip_reasons,
    round({ece_sql('kept', 'mp')}, 6) AS model_ece, round({ece_sql('kept', 'bp')}, 6) AS baseline_ece FROM sk""",
)
def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.score_split(scored_rows(spark, sf_dir), "event_key", "mp", "bp")
    return rounded(out.withColumn("skip_reasons", F.array_join("skip_reasons", ", ")))


@query(
    "brier",
    f"""WITH {SCORED_SQL} SELECT replace(event_key, chr(1), '|') AS event_key, round(sum((mp - y) ** 2), 6) AS brier
    FROM kept GROUP BY 1""",
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rounded(metrics.brier_by_event(_kept(spark, sf_dir), "event_key", "mp", "y")))


@query(
    "log_loss",
    f"""WITH {SCORED_SQL} SELECT round(avg(-ln(least(1 - 1e-15, greatest(1e-15, mp)))), 6) AS clipped_log_loss
    FROM kept WHERE y = 1""",
)
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.clipped_log_loss(_kept(spark, sf_dir), "mp", "y"))


@query("ece", f"WITH {SCORED_SQL} SELECT round({ece_sql('kept', 'mp')}, 6) AS ece")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.expected_calibration_error(_kept(spark, sf_dir), "mp", "y"))


@query(
    "prob_sum",
    f"WITH {SCORED_SQL} SELECT replace(event_key, chr(1), '|') AS event_key, m_ok AS sums_to_one FROM pe",
)
def prob_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_rows(spark, sf_dir).filter("settlement_label IS NOT NULL")
    return shown(rows.groupBy("event_key").agg(metrics.sums_to_one(F.col("mp")).alias("sums_to_one")))


@query(
    "sample_flag",
    f"""WITH {SCORED_SQL} SELECT CASE WHEN k < 30 THEN 'insufficient' ELSE 'meets_operational_minimum' END AS status,
    CASE WHEN k < 30 THEN 'inconclusive' ELSE 'descriptive_only' END AS conclusion, k AS scored_events,
    30 AS operational_minimum_scored_events FROM (SELECT count(*) FILTER (skip IS NULL) AS k FROM sk)""",
)
def sample_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.event_scores(scored_rows(spark, sf_dir), "event_key", "mp", "bp")
    return metrics.sample_sufficiency(
        scores.agg(F.count_if(F.col("skip_reason").isNull()).alias("scored_events"))
    )


@query(
    "bucket_coverage",
    f"WITH {SCORED_SQL} SELECT DISTINCT coalesce(bucket_label, '') AS bucket_label FROM lab",
)
def bucket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_coverage(scored_rows(spark, sf_dir))


# ---- breakdowns ---------------------------------------------------------------------------------------------

def test_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the forecast-error model's probability (null where the lookup misses)."""
    return _candidates(split_rows(spark, sf_dir))


def _candidates(rows: DataFrame) -> DataFrame:
    fit = materialize(models.fit_errors(_train(rows)), "fit")
    test = rows.filter("split = 'test'")
    return D.with_model_probability(test, models.predict_errors(test, fit))


EDGE_SQL = f"""{ERROR_PREDICT_SQL},
tc AS (SELECT t.*, ep.probability AS mp, ep.probability - t.market_probability AS edge FROM target t JOIN ep USING (event_key, token_id)
  WHERE t.split = 'test'),
tv AS (SELECT *, CASE WHEN lower(settlement_label) = 'yes' THEN 1 ELSE 0 END AS y FROM tc WHERE market_probability IS NOT NULL)"""
STATS_SQL = """count(*) AS n, round(avg({m}) + 1e-9, 6) AS mean_model_probability,
    round(avg(market_probability) + 1e-9, 6) AS mean_market_probability, round(avg(edge) + 1e-9, 6) AS mean_raw_edge,
    cast(sum(y) AS bigint) AS settled_yes_count, round(sum(y) / count(*) + 1e-9, 6) AS settled_yes_fraction"""
MV_SQL = f"""{B1}, mv AS (SELECT *, model_p - market_probability AS edge,
    CASE WHEN lower(settlement_label) = 'yes' THEN 1 ELSE 0 END AS y FROM b1m WHERE market_probability IS NOT NULL)"""


def fixed_sql(labels: tuple[str, ...], rows: str, label: str, m: str) -> str:
    dim = ", ".join(f"({i}, '{name}')" for i, name in enumerate(labels))
    return f"""SELECT d.ordinal, d.bucket, coalesce(s.n, 0) AS n, mean_model_probability, mean_market_probability, mean_raw_edge,
    coalesce(settled_yes_count, 0) AS settled_yes_count, settled_yes_fraction FROM (VALUES {dim}) AS d(ordinal, bucket)
    LEFT JOIN (SELECT {label} AS bucket, {STATS_SQL.format(m=m)} FROM {rows} GROUP BY 1) s ON s.bucket = d.bucket"""


EDGE_CASE = ("CASE WHEN edge <= 0 THEN '<=0%' WHEN edge <= 0.05::DOUBLE THEN '0-5%' WHEN edge <= 0.10::DOUBLE THEN '5-10%' "
             "WHEN edge <= 0.15::DOUBLE THEN '10-15%' WHEN edge <= 0.20::DOUBLE THEN '15-20%' ELSE '>20%' END")
PRICE_CASE = ("CASE WHEN market_probability < 0.01::DOUBLE THEN '<1c' WHEN market_probability < 0.03::DOUBLE THEN '1-3c' "
              "WHEN market_probability < 0.05::DOUBLE THEN '3-5c' WHEN market_probability < 0.10::DOUBLE THEN '5-10c' "
              "WHEN market_probability <= 0.25::DOUBLE THEN '10-25c' ELSE '>25c' END")
LEAD_CASE = ("CASE WHEN forecast_lead_hours > 48 THEN '>48h' WHEN forecast_lead_hours > 24 THEN '24-48h' "
             "WHEN forecast_lead_hours > 12 THEN '12-24h' WHEN forecast_lead_hours > 6 THEN '6-12h' "
             "WHEN forecast_lead_hours >= 1 THEN '1-6h' WHEN forecast_lead_hours < 1 THEN '<1h' END")


@query("edge_buckets", f"WITH {EDGE_SQL} {fixed_sql(C.EDGE_BUCKETS, 'tv', EDGE_CASE, 'mp')}")
def edge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.valid_candidates(test_candidates(spark, sf_dir))
    return means(D.fixed_bucket_stats(rows, M.edge_bucket(F.col("edge")), C.EDGE_BUCKETS))


ACCEPTED_EDGE_SQL = f"""{ACCEPT_SQL}, acc AS (SELECT * EXCLUDE (copy, code, detail) FROM routed WHERE code IS NULL),
{EDGE_SQL.removeprefix(B1 + ", ").replace("b1u", "acc")}"""


@query("accepted_edges", f"WITH {ACCEPTED_EDGE_SQL} {fixed_sql(C.EDGE_BUCKETS, 'tv', EDGE_CASE, 'mp')}")
def accepted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: identity, dedupe and group acceptance first; only accepted rows are split, fitted and scored."""
    columns = dict.fromkeys([*GROUP_COLUMNS, *(c for c in MODEL_COLUMNS if c != "event_key")])

    def accepted() -> DataFrame:
        return groups.accept_event_groups(snapshots(spark, sf_dir).select(*columns), ["seq"])[0].select(*MODEL_COLUMNS)

    rows = D.valid_candidates(_candidates(_split(settle(spark, accepted, "snapshots"))))
    return means(D.fixed_bucket_stats(rows, M.edge_bucket(F.col("edge")), C.EDGE_BUCKETS))


@query("price_buckets", f"WITH {MV_SQL} {fixed_sql(C.PRICE_BUCKETS, 'mv', PRICE_CASE, 'model_p')}")
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.valid_candidates(snapshots_scored(spark, sf_dir))
    return means(D.fixed_bucket_stats(rows, M.price_bucket(F.col("market_probability")), C.PRICE_BUCKETS))


@query("lead_buckets", f"WITH {MV_SQL} {fixed_sql(C.LEAD_BUCKETS, 'mv', LEAD_CASE, 'model_p')}")
def lead_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.valid_candidates(snapshots_scored(spark, sf_dir))
    return means(D.fixed_bucket_stats(rows, M.lead_bucket(F.col("forecast_lead_hours")), C.LEAD_BUCKETS))


def _group_sql(dimension: str, expr: str) -> str:
    return (f"SELECT '{dimension}' AS dimension, {expr} AS bucket, {STATS_SQL.format(m='model_p')} FROM mv GROUP BY 2")


@query(
    "group_breakdowns",
    f"WITH {MV_SQL} " + " UNION ALL ".join([
        _group_sql("city", "coalesce(nullif(city, ''), 'unknown')"),
        _group_sql("station_icao", "coalesce(nullif(station_icao, ''), 'unknown')"),
        _group_sql("event_month", "substr(event_date, 1, 7)"),
        _group_sql("season", "CASE WHEN substr(event_date, 6, 2) IN ('12', '01', '02') THEN 'winter' WHEN substr(event_date, 6, 2) "
                   "IN ('03', '04', '05') THEN 'spring' WHEN substr(event_date, 6, 2) IN ('06', '07', '08') THEN 'summer' ELSE 'autumn' END"),
        _group_sql("bucket_region", "CASE WHEN bucket_kind IN ('below', 'above') THEN 'tail' WHEN bucket_kind IN ('exact', 'range') "
                   "THEN 'center' ELSE 'unknown' END"),
    ]),
)
def group_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.valid_candidates(snapshots_scored(spark, sf_dir))
    return means(D.group_stats(rows, D.standard_groups()))


@query(
    "mispricing_summary",
    f"""WITH {B1} SELECT 'all' AS split_name, count(*) FILTER (market_probability IS NOT NULL) AS valid_candidates,
    count(*) FILTER (market_probability IS NULL) AS excluded_missing_model_or_market,
    count(*) FILTER (market_probability IS NOT NULL AND forecast_lead_hours IS NULL) AS missing_lead_hours_count,
    round(avg(model_p) FILTER (market_probability IS NOT NULL) + 1e-9, 6) AS average_model_probability,
    round(avg(market_probability) + 1e-9, 6) AS average_market_probability,
    round(avg(model_p - market_probability) + 1e-9, 6) AS average_raw_edge FROM b1m""",
)
def mispricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(D.mispricing_summary(snapshots_scored(spark, sf_dir), "all"))


@query(
    "threshold_counts",
    f"WITH {EDGE_SQL} " + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (edge >= {t}::DOUBLE) AS n FROM tv" for t in C.EDGE_THRESHOLDS
    ),
)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.threshold_counts(test_candidates(spark, sf_dir))


NULL_COLUMNS = ("pnl", "roi", "max_drawdown", "profit_factor", "win_rate", "average_executable_entry_price", "selected_threshold")
OUT_OF_SCOPE = "executable asks were present but fill simulation is out of scope"


@query(
    "backtest_eval",
    f"""WITH {B1} SELECT CASE WHEN t = 0 THEN 'non_executable' ELSE 'insufficient_data' END AS status,
    CASE WHEN t = 0 THEN 'CLOB prices-history does not reconstruct historical asks; no executable trades; PnL/ROI/drawdown/profit factor remain null'
      ELSE '{OUT_OF_SCOPE}' END AS reason, split_name, c AS candidates, t AS executable_trades, mk AS average_descriptive_market_probability,
    mo AS average_model_probability, ed AS average_raw_edge, 'not_applied_non_executable' AS fees_mode,
    {', '.join(f'cast(NULL AS double) AS {c}' for c in NULL_COLUMNS)} FROM (
      SELECT 'season:' || q AS split_name, count(*) FILTER (market_probability IS NOT NULL) AS c,
        count(*) FILTER (market_probability IS NOT NULL AND best_ask IS NOT NULL AND model_p - best_ask >= 0.05::DOUBLE) AS t,
        round(avg(market_probability) + 1e-9, 6) AS mk,
        round(avg(model_p) FILTER (market_probability IS NOT NULL) + 1e-9, 6) AS mo,
        round(avg(model_p - market_probability) + 1e-9, 6) AS ed
      FROM (SELECT *, CASE WHEN bucket_kind IN ('below', 'above') THEN 'tail' ELSE 'center' END AS q FROM b1m) GROUP BY 1)""",
)
def backtest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots_scored(spark, sf_dir)
    tail = F.coalesce(F.col("bucket_kind").isin("below", "above"), F.lit(False))
    parts = [
        D.backtest_evaluation(rows.filter(cond), f"season:{name}", 0.05)
        for name, cond in (("tail", tail), ("center", ~tail))
    ]
    return means(parts[0].unionByName(parts[1]))


BAND_SQL = fixed_sql(tuple(n for n, _l, _h in C.TAIL_BANDS), "(SELECT * FROM mv WHERE market_probability < 0.05)", PRICE_CASE, "model_p")


@query(
    "tail_bands",
    f"""WITH {MV_SQL} SELECT ordinal, bucket AS band, n, settled_yes_fraction, mean_model_probability, mean_raw_edge,
    settled_yes_count FROM ({BAND_SQL})""",
)
def tail_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(D.tail_bands(snapshots_scored(spark, sf_dir)))


@query(
    "tail_max_share",
    f"""WITH {MV_SQL} SELECT round(max(settled_yes_count) / nullif(sum(settled_yes_count), 0) + 1e-9, 6) AS max_band_settled_yes_share
    FROM ({BAND_SQL})""",
)
def tail_max_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(D.max_band_share(D.tail_bands(snapshots_scored(spark, sf_dir))))


@query(
    "survival_state",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN ok THEN CASE WHEN f IS NULL THEN 'UNKNOWN' WHEN f THEN 'MEASURED_SURVIVED'
      ELSE 'MEASURED_DID_NOT_SURVIVE' END END AS survival_state, st AS survival_status,
      CASE WHEN NOT ok THEN 'invalid executable survival combination' END AS survival_reject
    FROM (SELECT *, st = CASE WHEN f IS NULL THEN 'unknown_no_historical_asks' WHEN f THEN 'measured_survived' ELSE 'measured_did_not_survive' END AS ok
      FROM (SELECT *, coalesce(CASE l_linestatus WHEN 'O' THEN 'measured_survived' END,
        CASE WHEN f IS NULL THEN 'unknown_no_historical_asks' WHEN f THEN 'measured_survived' ELSE 'measured_did_not_survive' END) AS st
        FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS f FROM lineitem)))""",
)
def survival_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    status = F.when(F.col("l_linestatus") == "O", "measured_survived")
    out = D.survival_state(rows, flag, status)
    return out.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "survival_state", "survival_status", "survival_reject"
    )
