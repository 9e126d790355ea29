from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
NAMES = (
    "asof_price", "dedupe_quarantine", "ladder_topology", "group_acceptance", "score_split", "market_text",
    "price_explode", "weather_unpivot", "trades_normalize", "upsert_children", "stream_upsert",
    "snapshot_jsonl_roundtrip", "ladder_match", "merge_latest", "merge_children", "route_outcomes", "collection_counters",
)


@pytest.fixture(scope="module")
def checker():
    spec = importlib.util.spec_from_file_location("check_queries", ROOT / "tools" / "check_queries.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_catalogue_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, checker, name):
    ok, note = checker.compare(spark, SF, name)
    assert ok, note


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_partition_count_does_not_change_results(spark, checker):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            ok, note = checker.compare(spark, SF, "asof_price")
            assert ok, note
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
