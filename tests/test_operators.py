from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bucketwise.operators import asof, groups, keyed, lanes, metrics, models, normalize as N, validate as V
from bucketwise.operators.weather import localize_series

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("lane_rows", [asof.LANE_ROWS, 40])
def test_asof_matches_brute_force_with_one_hot_key(spark, lane_rows):
    rng = random.Random(7)
    points, asks = [], []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"
        points.append((key, T0 + timedelta(minutes=rng.randrange(40_000)), rng.choice([0.1, 0.4, 1.5, float("nan"), 0.9]), i))
    for i in range(200):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}"
        asks.append((i, key, T0 + timedelta(minutes=rng.randrange(40_000))))
    left = spark.createDataFrame(asks, "id int, k string, at timestamp")
    right = spark.createDataFrame(points, "k string, seen timestamp, p double, seq int").repartition(4)
    got = {
        r.id: r.p
        for r in asof.asof_price(
            left, right, by=["k"], decision_ts="at", observed_at="seen", price="p", first_seen=["seq"], lane_rows=lane_rows
        ).collect()
    }
    for i, key, at in asks:
        fit = [p for p in points if p[0] == key and p[1] <= at and at - p[1] <= timedelta(days=7) and 0 <= p[2] <= 1]
        want = max(fit, key=lambda p: (p[1], -p[3]))[2] if fit else None
        assert got[i] == want


def test_first_seen_flags_one_row_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(4)
    kept, copies = keyed.split_first_seen(df, ["k"], ["o"])
    assert {(r.k, r.o) for r in kept.collect()} == {("hot", 0)} | {(f"k{i}", i) for i in range(50)}
    assert copies.count() == 499
    assert keyed.first_per_key(df, ["k"], ["o"]).count() == 51


def test_upsert_is_idempotent_and_null_safe(spark):
    base = spark.createDataFrame([("a", None, 1, "old"), ("b", "x", 1, "keep")], "k string, m string, v int, d string")
    delta = spark.createDataFrame([("a", None, 2, "new")], base.schema)
    once = keyed.upsert(base, delta, ["k", "m"], ["v"])
    twice = keyed.upsert(once, delta, ["k", "m"], ["v"])
    want = {("a", None, 2, "new"), ("b", "x", 1, "keep")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in twice.collect()} == want


def test_dst_series(spark):
    walls = ["2024-10-27T02:30", "2024-10-27T02:30", "2024-10-27T02:30", "2024-03-31T02:30", "2024-07-01T12:00", "2024-07-01T12:00"]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(walls)], "s int, pos int, w string").withColumn(
        "wall", F.to_timestamp("w")
    ).withColumn("zone", F.lit("Europe/Paris"))
    out = localize_series(df, series=["s"], wall="wall", position=["pos"], zone="zone", offset_seconds=F.lit(0))
    got = [r.t for r in out.orderBy("pos").select(F.date_format("valid_time", "HH:mm").alias("t")).collect()]
    assert got == ["00:30", "01:30", None, None, "10:00", None]
    doc = spark.createDataFrame(
        [('{"timezone":"Europe/Paris","hourly":{"time":["2024-10-27T02:30","2024-10-27T02:30","2024-03-31T02:30"],"temperature_2m":[1,2,3]}}',)],
        "payload string",
    )
    times = N.weather_documents(doc).select("valid_times").first()[0]
    assert [t and (t.hour, t.minute) for t in times] == [(0, 30), (1, 30), None]


def ladder(spark, spans, **over):
    rows = []
    for i, (kind, lo, hi) in enumerate(spans):
        row = dict(
            condition_id=f"c{i}", market_id=None, token_id=f"t{i}", event_id="e1", neg_risk_market_id=None, event_slug=None,
            slug=None, question=None, city="paris", station_icao="LFPG", source_station_icao="LFPG", event_date="2026-07-15",
            decision_ts=T0, bucket_label=f"{lo}/{hi}", bucket_kind=kind, temperature_unit="F",
            temperature_native_min=lo, temperature_native_max=hi, settlement_label="Yes" if i == 0 else "No",
            provenance_urls=[], raw_paths=[], content_hashes=[], seq=i,
        )
        row.update({k: (v[i] if isinstance(v, list) else v) for k, v in over.items()})
        rows.append(row)
    ddl = (
        "condition_id string, market_id string, token_id string, event_id string, neg_risk_market_id string, event_slug string, "
        "slug string, question string, city string, station_icao string, source_station_icao string, event_date string, "
        "decision_ts timestamp, bucket_label string, bucket_kind string, temperature_unit string, temperature_native_min double, "
        "temperature_native_max double, settlement_label string, provenance_urls array<string>, raw_paths array<string>, "
        "content_hashes array<string>, seq int"
    )
    names = [f.split(" ")[0] for f in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


GOOD = [("below", None, 41.0), ("range", 42.0, 43.0), ("range", 44.0, 45.0), ("above", 46.0, None)]


@pytest.mark.parametrize(
    "spans,over,code,detail",
    [
        (GOOD, {}, None, None),
        ([GOOD[0], GOOD[1], ("range", 45.0, 46.0), ("above", 47.0, None)], {}, "event_bucket_structure_conflict", "gap:"),
        ([GOOD[0], GOOD[1], ("range", 43.0, 45.0), GOOD[3]], {}, "event_bucket_structure_conflict", "overlap:"),
        ([("below", None, 40.0), *GOOD[1:]], {}, "event_bucket_structure_conflict", "invalid_tail:low"),
        ([*GOOD[:3], ("above", 48.0, None)], {}, "event_bucket_structure_conflict", "invalid_tail:high"),
        ([GOOD[0], ("below", None, 30.0), *GOOD[1:]], {}, "event_bucket_structure_conflict", "invalid_tail:multiple"),
        (GOOD, {"city": ["paris", "london", "paris", "paris"]}, "event_city_conflict", "city"),
        (GOOD, {"temperature_unit": ["F", "C", "F", "F"]}, "event_unit_conflict", "temperature_unit"),
        (GOOD, {"settlement_label": "No"}, "event_settlement_unresolved", None),
        (GOOD, {"settlement_label": "Yes"}, "event_settlement_cardinality_conflict", None),
        (GOOD, {"settlement_label": ["No", None, "No", "No"]}, None, None),
        (GOOD, {"bucket_label": "same"}, "duplicate_outcome_conflict", None),
    ],
)
def test_event_group_verdicts(spark, spans, over, code, detail):
    rows = groups.with_event_key(ladder(spark, spans, **over))
    verdict = groups.group_verdicts(rows, ["seq"]).first()
    assert verdict.code == code
    assert (verdict.detail or "").startswith(detail or "")


def crowded(spark):
    """A large event of 40 keys with three copies each, a broken one, a good one and an ambiguous row."""
    big = [r for i in range(120) for r in [("exact", float(i % 40), float(i % 40))]]
    tokens = [f"t{i % 40}" for i in range(120)]
    rows = ladder(spark, big, token_id=tokens, condition_id=tokens, bucket_label=[f"{i % 40}F" for i in range(120)])
    good = ladder(spark, GOOD, event_id="good", condition_id=[f"g{i}" for i in range(4)])
    torn = ladder(spark, GOOD, event_id="torn", city=["paris", "london", "paris", "paris"])
    lost = ladder(spark, GOOD[:1], event_id=None, neg_risk_market_id=None, event_slug=None, slug=None, question=None, condition_id="lost")
    return rows.unionByName(good).unionByName(torn).unionByName(lost).repartition(3)


def test_large_events_are_spread_and_judged_alike(spark, monkeypatch):
    def routed():
        out = groups.route_event_groups(crowded(spark), ["seq"])
        return sorted((r.event_key, r.condition_id, r.seq, r["_code"] or "", r["_detail"] or "") for r in out.collect())

    rows = groups.with_row_id(groups.with_event_key(crowded(spark)), "crowded")
    whole, together = groups.clear_firsts(rows, ["seq"]), routed()
    monkeypatch.setattr(groups, "LANE_ROWS", 50)
    monkeypatch.setattr(groups, "EVENT_PARTS", 64)
    parts = groups.clear_firsts(rows, ["seq"])
    names = ["_row", "event_key", "token_id", "seq"]
    assert sorted(map(tuple, whole.select(*names).collect())) == sorted(map(tuple, parts.select(*names).collect()))
    assert "RepartitionByExpression [event_key" in (shape := parts._jdf.queryExecution().optimizedPlan().toString())
    assert "_spread" in shape.split("RepartitionByExpression [")[1].split("]")[0]
    assert routed() == together
    codes = [row[3] for row in together]
    assert codes.count("duplicate_snapshot") == 80 and codes.count("event_city_conflict") == 4
    assert codes.count("event_identity_ambiguous") == 1


def test_rows_meet_their_event_in_one_shuffle_and_leave_one_table(spark):
    from bucketwise.sources import scratch

    rows = groups.with_row_id(groups.with_event_key(crowded(spark)), "crowded")
    clear = groups.clear_firsts(rows, ["seq"])
    clear.collect()
    assert clear._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange hashpartitioning") == 1
    before = len(scratch._MADE)
    groups.route_event_groups(crowded(spark), ["seq"])
    assert len(scratch._MADE) == before + 2  # the rows and their verdicts


def test_wide_ladder_crosses_span_borders(spark):
    spans = [("exact", float(d), float(d)) for d in range(0, 200)]
    broken = spans[:130] + spans[131:]
    for s, want in ((spans, None), (broken, "gap:tokens=t129,t130;spans=129-129,131-131")):
        rows = groups.with_event_key(ladder(spark, s))
        assert groups.ladder_topology(rows, ["seq"]).first().topology_detail == want


def model_rows(spark):
    base = ladder(spark, GOOD).withColumn("event_key", F.lit("k")).withColumns(
        {
            "temperature_celsius_min": (F.col("temperature_native_min") - 32) * 5 / 9,
            "temperature_celsius_max": (F.col("temperature_native_max") - 32) * 5 / 9,
            "forecast_daily_max_c": F.lit(6.0),
            "diagnostic_actual_max_c": F.lit(7.0),
        }
    )
    return base


def test_whole_degree_fahrenheit_settlement(spark):
    rows = model_rows(spark)
    values = spark.createDataFrame([("k", (f - 32) * 5 / 9) for f in (10.0, 41.4, 41.5, 43.4, 43.5, 99.0)], "event_key string, value double")
    got = [r.token_id for r in models.match_values(values, models.ladder_rungs(rows)).orderBy("value").collect()]
    assert got == ["t0", "t0", "t1", "t1", "t2", "t3"]


def test_error_model_shares(spark):
    rows = model_rows(spark)
    fit = spark.createDataFrame([(None, -1.0, 3), (None, 0.5, 1), ("LFPG", 1.0, 2), ("LFPG", -2.0, 2)], "station string, error double, n bigint")
    got = {tuple(r) for r in models.predict_errors(rows, fit).collect()}
    assert {(t, p) for _k, t, _l, p in got} == {("t0", 0.5), ("t1", 0.0), ("t2", 0.5), ("t3", 0.0)}


def test_wide_ladder_matches(spark):
    n = 200_000
    rungs = spark.range(n).select(
        F.lit("k").alias("event_key"), F.lit("C").alias("unit"), F.lit(0).alias("priority"), F.col("id").cast("double").alias("lo"),
        F.col("id").cast("double").alias("hi"), F.concat(F.lit("t"), "id").alias("token_id"), F.lit("d").alias("event_date"), F.lit("c").alias("condition_id"),
    )
    values = spark.createDataFrame([("k", v) for v in (0.0, 0.4, 3.7, 1234.0, 199_999.49, 200_100.0)], "event_key string, value double")
    matched = models.match_values(values, rungs)
    assert "collect_list" not in matched._jdf.queryExecution().toString()
    assert [r.token_id for r in matched.orderBy("value").collect()] == ["t0", "t0", "t4", "t1234", "t199999", None]


def accepts(unit, kind, lo, hi, value):
    if unit == "F":
        value = value * 9.0 / 5.0 + 32.0
        value = float(math.floor(value + 0.5) if value >= 0 else math.ceil(value - 0.5))
    if kind == 0:
        whole = math.floor(lo + 0.5) if lo >= 0 else math.ceil(lo - 0.5)
        return value == whole if unit == "F" else abs(value - lo) < 0.5
    return (kind not in (1, 3) or value >= lo) and (kind not in (1, 2) or value <= hi)


def random_ladders(seed, events):
    """Overlapping rungs of all kinds on tenths, with bounds around zero, and values next to their bounds."""
    rng = random.Random(seed)
    rungs, values = [], []
    for e in range(events):
        unit, key = rng.choice("CF"), f"e{e}"
        near = []
        for i in range(rng.randrange(1, 14)):
            lo, kind = rng.choice([rng.randrange(-12, 12) / 10, float(rng.randrange(-20, 60))]), rng.randrange(4)
            hi = lo + rng.choice([0.0, 0.1, 1.0, 30.0, -1.0])
            rungs.append((key, unit, kind, lo, hi, f"t{rng.randrange(100):02d}{i}", "d", "c"))
            near += [lo - 0.5, lo + 0.5, lo, hi, lo - 0.4, hi + 0.3]
        if unit == "F":
            near = [(x + rng.choice([0.0, 0.5, -0.5]) - 32) * 5 / 9 for x in near]
        values += {(key, y) for x in near for y in (x, math.nextafter(x, -99), math.nextafter(x, 99))}
    return rungs, values


def winner(rungs, key, value):
    fit = [(r[2], r[5]) for r in rungs if r[0] == key and accepts(r[1], r[2], r[3], r[4], value)]
    return min(fit)[1] if fit else None


RUNGS = "event_key string, unit string, priority int, lo double, hi double, token_id string, event_date string, condition_id string"


def test_overlapping_ladders_equal_brute_force(spark):
    rungs, values = random_ladders(3, 60)
    got = models.match_values(
        spark.createDataFrame(values + [("none", 1.0), ("e0", None)], "event_key string, value double"), spark.createDataFrame(rungs, RUNGS)
    ).collect()
    assert len(got) == len(values) + 2
    for r in got:
        assert r.token_id == (None if r.value is None else winner(rungs, r.event_key, r.value)), r


@pytest.mark.parametrize("lane_rows", [lanes.LANE_ROWS, 7])
def test_prefix_sums_equal_brute_force(spark, lane_rows, monkeypatch):
    monkeypatch.setattr(lanes.running_total, "__defaults__", (lane_rows,))
    monkeypatch.setattr(lanes.last_before, "__defaults__", (lane_rows,))
    rng = random.Random(9)
    errors = [(s, rng.randrange(-300, 300) / 10 + rng.choice([0.0, 1e-15, 1e-9]), rng.randrange(1, 5)) for s in "ab" for _ in range(150)]
    asked = {
        (rng.choice("abz"), rng.randrange(-50, 300) / 10, rng.choice("CF"), rng.choice([float(rng.randrange(-20, 90)), rng.randrange(-90, 90) / 10]), rng.random() < 0.5)
        for _ in range(400)
    }
    got = models.errors_below(
        spark.createDataFrame(list(asked), "source string, forecast double, unit string, bound double, behind boolean"),
        spark.createDataFrame(errors, "source string, error double, n bigint").groupBy("source", "error").agg(F.sum("n").alias("n")),
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        def settles(x):
            if r.unit == "C":
                return x
            x = x * 9.0 / 5.0 + 32.0
            return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)
        want = sum(n for s, e, n in errors if s == r.source and (settles(r.forecast + e) < r.bound or r.behind and settles(r.forecast + e) == r.bound))
        assert r.below == want, r


def test_one_day_of_one_key_is_cut_into_lanes(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.lit("k")).otherwise("hot").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id") * 1000).otherwise(F.col("id")).alias("at"), "id"
    )
    sizes = lanes.with_lane(rows, ["k"], "at", lane_rows=5000).groupBy("k", "_lane").count().collect()
    hot = [r["count"] for r in sizes if r.k == "hot"]
    assert sum(hot) == n * 9 // 10 and len(hot) > 500 and max(hot) < 200
    assert [r["count"] for r in sizes if r.k == "k"] == [n // 10]
    total = lanes.running_total(rows, ["k"], "at", F.col("id"), "upto", lane_rows=5000).where("k = 'hot'").orderBy("at").collect()
    want = 0
    for r in total:
        want += r.id
        assert r.upto == want


def test_no_history_is_uniform(spark):
    rows = model_rows(spark)
    empty = spark.createDataFrame([], "station string, error double, n bigint")
    assert {r.probability for r in models.predict_errors(rows, empty).collect()} == {0.25}


def test_split_sizes(spark):
    df = spark.createDataFrame([(f"2026-03-{d:02d}",) for d in range(1, 31)], "event_date string")
    got = {r["split"]: r["count"] for r in models.split_dates(df).groupBy("split").count().collect()}
    assert got == {"train": 18, "validation": 6, "test": 6}
    with pytest.raises(ValueError):
        models.split_dates(df, 0.5, 0.2, 0.2)


def test_scoring_skips_and_metrics(spark):
    data = [
        ("a", "Yes", 0.7), ("a", "No", 0.3), ("b", "No", 1.0), ("c", "Yes", 0.5), ("c", "Yes", 0.5),
        ("d", "Yes", None), ("d", "No", 0.1), ("e", "Yes", 0.9), ("e", "No", 0.3),
    ]
    df = spark.createDataFrame([(k, lab, p, 0.5) for k, lab, p in data], "k string, settlement_label string, m double, b double")
    out = metrics.score_split(df.filter("k <> 'b' OR true"), "k", "m", "b").first()
    assert out.scored_events == 1 and out.skipped_events == 4
    assert out.model_brier == pytest.approx(0.18)
    assert out.model_log_loss == pytest.approx(0.35667494)
    assert out.skip_reasons == [
        "missing model or baseline probabilities (1)", "multiple YES winners (1)",
        "probabilities missing or not normalized (1)", "zero YES winners (1)",
    ]


def verdict(spark, rule, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    rows = V.parsed(df).select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r["status"] for r in rows]


def test_price_history_verdicts(spark):
    got = verdict(
        spark, V.price_history_verdict,
        ['{"history":[{"t":1720000000,"p":"0.41"}]}', '{"history":[]}', '{"history":[{"t":true,"p":0.2}]}',
         '{"history":[{"t":1,"p":true}]}', '{"history":[{"t":1}]}', '{"history":{}}', '{"error":"x"}', '[]', '{}',
         '{"history":[{"t":10,"p":0.2,"extra":"ok"}],"unused":1}', '{"history":[{"t":null,"p":0.2}]}'],
    )
    assert got == ["ok", "empty", "malformed", "malformed", "malformed", "malformed", "source_drift", "malformed", "malformed",
                   "ok", "malformed"]


def test_search_verdicts(spark):
    got = verdict(
        spark, V.search_verdict,
        ['{"error":"nope"}', '{"events":"x"}', '{"markets":{}}', '{"unexpected":true}', '{"events":[{"id":"","markets":[]}]}',
         '{"events":[{"id":"1","markets":"bad"}]}', '{"events":[{"id":"1","markets":[null]}]}', '{"events":[],"markets":["scalar"]}',
         '{"events":[],"markets":[]}', '{"markets":[{"id":7,"question":"x"}]}'],
    )
    assert got == ["source_drift", "malformed", "malformed", "source_drift", "malformed", "malformed", "malformed", "malformed", "empty", "ok"]


def test_search_verdict_names_the_first_fault_and_reads_a_market_once(spark):
    topical = '{"id":1,"question":"Highest temperature in Paris","groupItemTitle":"3","tokens":["a"]}'
    docs = [
        '{"events":[{"id":1,"markets":[' + topical + ']}]}', '{"markets":[' + topical.replace("Paris", "Oslo") + ']}',
        '{"events":[{"id":1,"markets":[{"conditionId":" ","id":2}]},7],"markets":"x"}',
        '{"events":[{"id":1,"markets":[{"conditionId":null,"id":2},[]]},7]}', '{"events":[{"id":true}]}', '{"events":[{"id":1,"markets":[]}],"markets":null}',
        '{"markets":[]}', '[1]', 'no json', '{"error":null}', '{"events":[],"markets":[{"conditionId":false}]}',
    ]
    df = V.parsed(spark.createDataFrame(list(enumerate(docs)), "i int, payload string"))
    out = df.select("i", V.search_verdict(F.col("v")).alias("r")).select("i", "r.*")
    lacks = "structurally valid gamma payload lacks Phase 3 weather eligibility fields"
    assert [(r.status, r.detail, r.eligibility) for r in out.orderBy("i").collect()] == [
        ("ok", None, "eligible"), ("ok", lacks, "ineligible"),
        ("malformed", "gamma search markets must be a list", "not_applicable"),
        ("malformed", "gamma search market must be an object", "not_applicable"),
        ("malformed", "gamma search event markets must be a list", "not_applicable"),
        ("malformed", "gamma search markets must be a list", "not_applicable"),
        ("empty", None, "not_applicable"), ("malformed", "gamma search payload must be an object", "not_applicable"),
        ("malformed", "gamma search payload must be an object", "not_applicable"),
        ("source_drift", "gamma search error object is not a valid search container", "not_applicable"),
        ("ok", lacks, "ineligible"),
    ]
    # one reading of the markets inside events and one of the others, whatever the number of columns
    assert out._jdf.queryExecution().optimizedPlan().toString().count("gamma search market missing required identity") == 2


def test_fits_do_not_depend_on_the_place_of_equal_tokens(spark):
    # one token of a day in two events, as it happens where families differ by city only
    rows = [("t", "2024-01-01", "c", "KAAH", "london", "a", 8.0, 11.0, "yes", "e"),
            ("t", "2024-01-01", "c", "KAAH", "milan", "a", 9.0, 8.0, "yes", "e")]
    schema = ("token_id string, event_date string, condition_id string, station_icao string, city string, bucket_label string, "
              "forecast_daily_max_c double, diagnostic_actual_max_c double, settlement_label string, event_key string")
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).coalesce(1)
        assert {(r.station, r.error, r.n) for r in models.fit_errors(df).collect()} == {("KAAH", 3.0, 1), (None, 3.0, 1)}
        assert {r.city for r in models.fit_frequency(df).collect()} == {None, "london"}
        assert models._event_heads(df).collect()[0].city == "london"


def test_event_date_conflicts(spark):
    q = "Will the highest temperature in Paris be 31°C on July 15, 2026?"
    q_no_year = "Will the highest temperature in Paris be 31°C on July 15?"
    slug, other = "highest-temperature-in-paris-on-july-15-2026", "highest-temperature-in-paris-on-july-16-2026"
    rows = [
        (q, slug, None, None), (q, other, None, None), (q_no_year, None, None, None),
        (q_no_year, None, "Resolves 15 Jul '26", None), (None, None, "Resolves July 15, 2026", None), (q, slug, None, "2026-07-16"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, slug string, description string, eventDate string")
    df = df.withColumns({"event_date": F.lit(None).cast("string"), "date": F.lit(None).cast("string")})
    got = [r.d for r in N.event_date_evidence(df).orderBy("i").select(F.col("event_date_found").alias("d")).collect()]
    assert got == ["2026-07-15", None, None, "2026-07-15", None, None]


def test_packed_working_tables_are_not_broadcast(spark):
    from bucketwise.plans import registry
    from bucketwise.sources.scratch import materialize

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.codegen.hugeMethodLimit")
    settings = {n: spark.conf.get(n) for n in names if spark.conf.get(n, None) is not None}

    def joined(session, _dir):
        # a few hundred kB of files, 32 MB of rows
        packed = materialize(session.range(0, 400_000, 1, 2).select("id", F.repeat(F.lit("x"), 60).alias("text")), "packed")
        return session.range(1_000_000).withColumnRenamed("id", "at").join(packed, F.expr("at = id"))

    try:
        registry.query("probe")(joined)
        rows = registry.QUERIES["probe"](spark, "")
        assert rows.count() == 400_000
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        registry.QUERIES.pop("probe", None)
        for name in names:
            spark.conf.unset(name) if name not in settings else spark.conf.set(name, settings[name])
