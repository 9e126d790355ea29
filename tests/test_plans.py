"""Costly steps are made once: what the planner would repeat is held in a column or a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bucketwise.functions import text as X
from bucketwise.operators import groups, normalize as N


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weather_documents_are_parsed_once(spark):
    docs = spark.createDataFrame(
        [("S1", '{"timezone":"UTC","hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"temperature_2m":[1.5,null]}}'),
         ("S2", '{"timezone":"UTC","hourly":{"time":[],"temperature_2m":[]}}'), ("S3", "[1]")],
        "station_id string, payload string",
    )
    cube = N.run_cube(N.weather_documents(docs.repartition(2)), ["station_id"], F.lit("UTC"))
    assert plan(cube).count("parseJson") == 1
    got = sorted((r.station_id, r.local_date, r.temperature_c) for r in cube.collect() if r.temperature_c is not None)
    assert got == [("S1", "2024-01-01", 1.5)] and cube.count() == 2


def test_patterns_run_once_a_text(spark):
    df = spark.createDataFrame([("a-1",)], "t string").repartition(2)
    assert plan(df.select(F.when(F.col("t") != "b", X.group(F.col("t"), r"-(\d)", 1)).alias("g"))).count("regexp_extract") == 1


@pytest.mark.parametrize("slug, family", [
    ("Will-The-high-in-paris-on-may-1-11-17c", "high-in-paris-on-may-1"), ("x-25F", "x"), ("x-25c\n", "x\n"), ("-25c", None),
    ("x-10c-or-below", "x-10c"), ("x-or-higher\n", "x\n"), ("x-be-25c-on-may-1", "x-on-may-1"), ("magic", "magic"), ("", None),
])
def test_slug_families_of_odd_endings(spark, slug, family):
    df = spark.createDataFrame([(slug,)], "s string")
    assert df.select(X.slug_family(F.col("s")).alias("f")).first().f == family


def test_child_texts_are_lowered_once(spark):
    df = spark.createDataFrame([("Will the highest temperature in New  York be 5°C on May 2?", None)], "question string, slug string")
    out = groups.child_evidence(df.repartition(2))
    row = out.first()
    assert (row.text_cities, row.question_day, row.slug_day, row.off_topic) == (["new york"], "may-2", None, True)
    assert plan(out).count("lower(concat_ws") == 1


def test_ladders_read_their_rungs_from_a_table(spark):
    df = spark.createDataFrame(
        [("e", "t1", 1, "below", None, 10.0, "C"), ("e", "t2", 2, "range", 11.0, 17.0, "C"), ("e", "t3", 3, "above", 19.0, None, "C")],
        "event_key string, token_id string, seq int, bucket_kind string, temperature_native_min double, temperature_native_max double, "
        "temperature_unit string",
    )
    out = groups.ladder_topology(df, ["seq"])
    assert "LocalRelation" not in plan(out) and "LogicalRDD" not in plan(out)
    assert out.first().topology_detail == "invalid_tail:high;above_lo=19.0;last_interior_hi=17.0"


def left_tables(make) -> list[str]:
    """The kinds of working tables that are there when a query is ready to be read."""
    from bucketwise.sources import scratch

    before = set(scratch._MADE)
    make().count()
    return sorted(path.rpartition("/")[2].rpartition("-")[0] for path in scratch._MADE if path not in before)


def test_a_query_keeps_only_the_tables_it_reads(spark):
    from bucketwise.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    assert left_tables(lambda: QUERIES["error_predict"](spark, sf)) == ["fit", "snapshots", "split-dates", "weights"]
    assert left_tables(lambda: QUERIES["accepted_edges"](spark, sf)) == ["fit", "snapshots", "split-dates", "weights"]


def test_group_facts_are_one_aggregation_of_written_rows(spark):
    from bucketwise.plans.catalog import QUERIES

    assert left_tables(lambda: QUERIES["group_weak_evidence"](spark, "/root/testdata/sf0.001")) == ["grouped"]
    facts = plan(QUERIES["group_conflicts"](spark, "/root/testdata/sf0.001"))
    texts = [line for line in facts.splitlines() if "Aggregate [event_key" in line and "x_slug_family" in line]
    assert len(texts) == 1 and "Window" not in facts
