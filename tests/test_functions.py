from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bucketwise.functions import classify as M, identity as I, text as X, times as T


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_class_boundaries(spark):
    edges = [0.0, 0.05, 0.0500001, 0.10, 0.15, 0.2, 0.21, -1.0]
    assert many(spark, edges, M.edge_bucket, "double") == [
        "<=0%", "0-5%", "5-10%", "5-10%", "10-15%", "15-20%", ">20%", "<=0%",
    ]
    prices = [0.0, 0.01, 0.03, 0.05, 0.10, 0.25, 0.26, None]
    assert many(spark, prices, M.price_bucket, "double") == [
        "<1c", "1-3c", "3-5c", "5-10c", "10-25c", "10-25c", ">25c", None,
    ]
    hours = [49.0, 48.0, 24.0, 12.0, 6.0, 1.0, 0.5, None]
    assert many(spark, hours, M.lead_bucket, "double") == [
        ">48h", "24-48h", "12-24h", "6-12h", "1-6h", "1-6h", "<1h", None,
    ]
    assert many(spark, [0.0, 0.01, 0.03, 0.05, None], M.tail_band, "double") == [
        "<1c", "1-3c", "3-5c", None, None,
    ]


def test_settlement_degree(spark):
    values = [53.5, 53.4, -0.5, 0.49999999999999994, 40.9]
    assert many(spark, values, M.settlement_degree, "double") == [54, 53, -1, 1, 41]


def test_probability_and_number_guards(spark):
    values = [None, float("nan"), -0.1, 1.5, 0.0, 1.0]
    assert many(spark, values, M.is_valid_probability, "double") == [False] * 4 + [True, True]
    texts = ["", " ", "x", "NaN", "Infinity", "0", "1.5"]
    assert many(spark, texts, M.finite_number) == [None] * 5 + [0.0, 1.5]


def test_bucket_labels(spark):
    labels = ["10°C or below", "52-53°F", "30", "-5", "12–10 Celsius", "60°F or higher", "10 or below", "warm"]
    got = many(spark, labels, X.temperature_bucket)
    assert [(g and (g["kind"], g["unit"], g["native_min"], g["native_max"])) for g in got] == [
        ("below", "C", None, 10.0), ("range", "F", 52.0, 53.0), ("exact", "C", 30.0, 30.0),
        ("exact", "C", -5.0, -5.0), ("range", "C", 10.0, 12.0), ("above", "F", 60.0, None), None, None,
    ]
    assert got[1]["min_c"] == pytest.approx((52 - 32) * 5 / 9)


def test_families(spark):
    slugs = [
        "highest-temperature-in-nyc-on-march-21-2026-52-53f",
        "will-the-highest-temperature-in-paris-be-25c-on-july-15", None, " ",
    ]
    assert many(spark, slugs, X.slug_family) == [
        "highest-temperature-in-nyc-on-march-21-2026", "highest-temperature-in-paris-on-july-15", None, None,
    ]
    q = "Will the highest temperature in Paris be between 20 and 21°C on July 15, 2026?"
    assert one(spark, q, X.question_family) == "highest temperature in paris on july 15, 2026"


def test_parse_instant(spark):
    texts = ["1720000000", "1720000000000", "2024-01-01", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00",
             "2024-01-01T10:00:00", "noon", ""]
    got = many(spark, texts, lambda c: T.iso_utc(T.parse_instant(c)))
    assert got == [
        "2024-07-03T09:46:40+00:00", "2024-07-03T09:46:40+00:00", "2024-01-01T00:00:00+00:00",
        "2024-01-01T10:00:00+00:00", "2024-01-01T08:00:00+00:00", None, None, None,
    ]


def test_decision_is_wall_clock(spark):
    got = one(spark, "2024-04-01", lambda c: T.iso_utc(T.decision_instant(c, F.lit("Europe/Paris"), F.lit(24.0))))
    assert got == "2024-03-30T23:00:00+00:00"


def test_settlement_labels(spark):
    rows = [
        (True, '["Yes","No"]', '["1","0"]'), (False, '["Yes","No"]', '["1","0"]'),
        (True, '["Yes"]', '["1"]'), (True, '["Yes","No"]', '["1","0","0"]'), (True, '["Yes","No"]', '["0.4","0.6"]'),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c boolean, o string, p string")
    s = X.settlement_label(F.col("c"), F.lit(None).cast("boolean"), F.col("o"), F.col("p"))
    got = [r.s for r in df.select("i", s.alias("s")).orderBy("i").collect()]
    assert [g["label"] for g in got] == ["Yes", None, None, None, None]
    assert [bool(g["reason"]) for g in got] == [False, True, True, True, True]
    assert len({g["reason"] for g in got[1:]}) == 4


def test_canonical_url(spark):
    urls = ["https://a.b/c?z=1&a=2#f", "https://a.b/c#f", "https://a.b/c?x&b=a%20b", "https://a.b/c?"]
    assert many(spark, urls, I.canonical_url) == [
        "https://a.b/c?a=2&z=1", "https://a.b/c", "https://a.b/c?b=a+b&x=", "https://a.b/c",
    ]


def test_forecast_run(spark):
    df = spark.createDataFrame(
        [("2024-03-01 07:30:00", "2024-03-02 23:59:59"), ("2024-03-01 07:30:00", "2024-04-02 23:59:59")],
        "d string, e string",
    )
    run = T.forecast_run(F.col("d").cast("timestamp"), F.col("e").cast("timestamp"))
    got = [r.r for r in df.select(T.iso_utc(run).alias("r")).collect()]
    assert got == ["2024-03-01T00:00:00+00:00", None]


def test_parse_instant_forms(spark):
    texts = ["2024-10-27T02:30Z", "2024-10-27T02:30+05:00", "2024-10-27 02:30:00+00", "2024-10-27T02:30:00.5-0330",
             "2024-10-27T02:30:15+05:30:10", "2024-10-27T02:30", "2024-10-27T25:30Z"]
    assert many(spark, texts, lambda c: T.iso_utc(T.parse_instant(c))) == [
        "2024-10-27T02:30:00+00:00", "2024-10-26T21:30:00+00:00", "2024-10-27T02:30:00+00:00",
        "2024-10-27T06:00:00.500000+00:00", "2024-10-26T21:00:05+00:00", None, None,
    ]


def test_folds_of_any_length(spark):
    cases = [
        ("2024-10-27 02:30:00", "Europe/Paris", "2024-10-27T00:30:00+00:00", "2024-10-27T01:30:00+00:00", "ambiguous"),
        ("2024-10-27 01:30:00", "Antarctica/Troll", "2024-10-26T23:30:00+00:00", "2024-10-27T01:30:00+00:00", "ambiguous"),
        ("2007-12-09 02:45:00", "America/Caracas", "2007-12-09T06:45:00+00:00", "2007-12-09T07:15:00+00:00", "ambiguous"),
        ("2024-04-07 01:45:00", "Australia/Lord_Howe", "2024-04-06T14:45:00+00:00", "2024-04-06T15:15:00+00:00", "ambiguous"),
        ("2024-03-31 02:30:00", "Europe/Paris", None, None, "gap"),
        ("2024-07-01 12:00:00", "Europe/Paris", "2024-07-01T10:00:00+00:00", None, "unambiguous"),
        ("2024-07-01 12:00:00", "Factory", "2024-07-01T11:00:00+00:00", "2024-07-01T11:00:00+00:00", "fixed"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, wall string, zone string")
    rows = rows.select("i", F.col("wall").cast("timestamp").alias("wall"), T.checked_zone(F.col("zone")).alias("zone"))
    at = lambda n: T.iso_utc(T.local_to_utc(F.col("wall"), F.col("zone"), F.lit(3600), F.lit(n)))
    got = rows.select(at(0), at(1), at(2), T.local_kind(F.col("wall"), F.col("zone"))).orderBy("i").collect()
    assert [(r[0], r[1], r[3]) for r in got] == [c[2:] for c in cases]
    assert [r[2] for r in got] == [None] * 6 + ["2024-07-01T11:00:00+00:00"]


def test_every_known_zone_is_one_of_the_jvm(spark):
    from zoneinfo import available_timezones

    zones = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")
    known = zones.select(T.checked_zone(F.col("zone")).alias("zone")).where("zone is not null")
    shifted = known.select(F.from_utc_timestamp(F.timestamp_seconds(F.lit(0)), F.col("zone")).alias("t")).collect()
    assert len(shifted) >= 590


def test_year_of_hours_in_one_document(spark):
    import json
    from datetime import datetime, timedelta

    from bucketwise.operators import normalize

    hours = [(datetime(2024, 1, 1) + timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M") for i in range(8760)]
    hours[100] = hours[100] + "-05:00"
    hours += [hours[7], hours[7]]
    doc = json.dumps({"timezone": "Europe/Paris", "utc_offset_seconds": 3600, "hourly": {"time": hours}})
    frame = spark.createDataFrame([(doc,)], "payload string")
    times = normalize.weather_documents(frame).select(F.transform("valid_times", T.iso_utc).alias("t")).first()["t"]
    assert times[0] == "2023-12-31T23:00:00+00:00" and times[100] == "2024-01-05T09:00:00+00:00"
    assert times[-2:] == [None, None] and len(times) == 8762
    fold = hours.index("2024-03-31T02:00")
    assert times[fold] is None
