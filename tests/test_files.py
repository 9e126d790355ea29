from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bucketwise.operators import keyed, merge, normalize as N, weather as W
from bucketwise.sources import rawstore, snapshots as files, stations as S, versions
from bucketwise.streaming import ingest

FIELDS = ("transactionHash", "conditionId", "asset", "timestamp", "side", "price", "size", "outcome", "outcomeIndex", "id", "market")


def trades(spark):
    rows = []
    for i in range(60):
        key = i % 17
        rows.append((i, f"0h{key}", f"0x{key % 5}", "a" if i % 7 else "", str(1720000000 + key), "BUY", "0.5" if i % 11 else "NaN",
                     "2", "Yes", "0", None if i % 3 else f"t{key}", f"0x{key % 5}"))
    return spark.createDataFrame(rows, "seq long, " + ", ".join(f"{f} string" for f in FIELDS))


@pytest.mark.parametrize("cut", [1, 5, 12])
def test_stream_result_does_not_depend_on_the_cut(spark, tmp_path, cut):
    rows = trades(spark)
    rows.repartitionByRange(cut, F.pmod(F.xxhash64("seq"), F.lit(97))).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    judge = lambda batch: N.judge_trades(batch, ["seq"])
    ingest.ingest_stream(source, f"{tmp_path}/table", f"{tmp_path}/checkpoint", judge)
    want, rejects = N.normalize_trades(rows, ["seq"])
    got, bad = N.split_judged(ingest.read_judged(spark, f"{tmp_path}/table"), ["seq"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, rejects.collect())) != []
    assert len(ingest.folders(spark, f"{tmp_path}/table")) == cut
    # a batch that comes again is part of the table already
    again = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.ingest_stream(again, f"{tmp_path}/table", f"{tmp_path}/lost-checkpoint", judge)
    assert len(ingest.folders(spark, f"{tmp_path}/table")) == cut
    assert ingest.read_judged(spark, f"{tmp_path}/table").count() == N.judge_trades(rows, ["seq"]).count()
    # the compacted part and newer batches only
    ingest.ingest_stream(again, f"{tmp_path}/small", f"{tmp_path}/small-checkpoint", judge, ["trade_id"], ["seq"], compact_every=2)
    opened = ingest.folders(spark, f"{tmp_path}/small")
    assert [f.split("-")[0] for f in opened] == ["compacted"] * (cut > 1) + ["batch"] * (cut % 2)
    small, _ = N.split_judged(ingest.read_judged(spark, f"{tmp_path}/small"), ["seq"])
    assert sorted(map(str, small.collect())) == sorted(map(str, want.collect()))


def test_one_of_two_writers_is_refused(spark, tmp_path):
    versions.publish(spark, f"{tmp_path}/t", 0, {"a": 1})
    with pytest.raises(FileExistsError):
        versions.publish(spark, f"{tmp_path}/t", 0, {"a": 2})
    assert versions.current(spark, f"{tmp_path}/t") == (1, {"a": 1})


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 3 > 0, "m").alias("m"), F.lit(1).alias("v"), "id")
    merge.create(rows, f"{tmp_path}/t", ["k", "m"], buckets=16)
    before, names = files_of(tmp_path), set(merge.versions.current(spark, f"{tmp_path}/t")[1]["buckets"].items())
    delta = spark.createDataFrame([("k0", None, 2, 900), ("k0", "", 3, 901), ("k1", "m", 0, 902), ("new", "m", 1, 903)], "k string, m string, v int, id long")
    for _ in range(2):  # twice the same
        merge.upsert_into(f"{tmp_path}/t", delta, ["v"])
        want = keyed.upsert(rows, delta, ["k", "m"], ["v"])
        assert sorted(map(tuple, merge.read(spark, f"{tmp_path}/t").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    after = files_of(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before
    moved = names - set(merge.versions.current(spark, f"{tmp_path}/t")[1]["buckets"].items())
    assert 1 <= len(moved) <= 3 and len(names) == 16
    merge.upsert_into(f"{tmp_path}/t", delta.limit(0), ["v"])
    assert merge.read(spark, f"{tmp_path}/t").count() == 501


def test_merge_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v int")
    merge.create(empty, f"{tmp_path}/t", ["k"], buckets=4)
    assert merge.read(spark, f"{tmp_path}/t").count() == 0
    merge.upsert_into(f"{tmp_path}/t", spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], empty.schema), ["v"])
    assert sorted(map(str, merge.read(spark, f"{tmp_path}/t").collect())) == ["Row(k='a', v=2)", "Row(k=None, v=1)"]


def test_merged_parents_keep_their_first_id_and_last_children(spark, tmp_path):
    parents = spark.createDataFrame([], "id string, k string, v int")
    children = spark.createDataFrame([], "id string, level int")
    merge.create(parents, f"{tmp_path}/p", ["k"], buckets=8)
    merge.create(children, f"{tmp_path}/c", ["id"], buckets=8)

    def write(rows, levels):
        merge.upsert_parents_into(
            f"{tmp_path}/p", f"{tmp_path}/c", spark.createDataFrame(rows, parents.schema),
            spark.createDataFrame(levels, "id string, v int, level int"), id_col="id", version=["v"],
        )

    write([("a", "x", 1), ("b", "y", 1)], [("a", 1, 0), ("a", 1, 1), ("b", 1, 0)])
    for _ in range(2):
        write([("c", "x", 2), ("d", "y", 0), ("e", "z", 1)], [("c", 2, 7), ("d", 0, 8)])
        assert sorted(map(tuple, merge.read(spark, f"{tmp_path}/p").collect())) == [("a", "x", 2), ("b", "y", 1), ("e", "z", 1)]
        assert sorted(map(tuple, merge.read(spark, f"{tmp_path}/c").collect())) == [("a", 7), ("b", 0)]


def test_quarantine_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert files.read_quarantine_log(spark, path).count() == 0 == files.read_quarantine(spark, f"{tmp_path}/none").count()
    rows = spark.createDataFrame([("unknown station X; a", "c1"), (None, "c2"), ("b/c=d", "c3")], "reason string, condition_id string")
    files.write_quarantine(rows, path)
    files.write_quarantine(rows.where("condition_id = 'c1'"), path)
    got = sorted((r["reason"], r["condition_id"]) for r in files.read_quarantine_log(spark, path).collect())
    assert got == [("b/c=d", "c3"), ("unknown station X; a", "c1"), ("unknown station X; a", "c1"), ("unspecified", "c2")]
    assert files.read_quarantine_log(spark, path, "b/c=d").count() == 1
    (tmp_path / "doc.json").write_text(json.dumps([{"reason": "r", "condition_id": "c"}, 7]))
    assert [r["reason"] for r in files.read_quarantine(spark, f"{tmp_path}/doc.json").collect()] == ["r"]


def test_raw_store_keeps_each_document_once(spark, tmp_path):
    docs = spark.createDataFrame(
        [("s", "https://h/a?b=1", '{"b": 1, "a": 2}'), ("s", "https://h/a?b=1", '{"a":2,"b":1}'), ("s", "https://h/a?b=2", "no json")],
        "source string, url string, payload string",
    )
    addressed = rawstore.address_payloads(docs, source="source", url="url", payload="payload")
    assert rawstore.store_payloads(spark, addressed, f"{tmp_path}/raw").count() == 2
    more = addressed.unionByName(
        rawstore.address_payloads(docs.limit(1).withColumn("url", F.lit("https://h/z")), source="source", url="url", payload="payload")
    )
    held = rawstore.store_payloads(spark, more, f"{tmp_path}/raw")
    assert held.count() == 3 and held.select("raw_path").distinct().count() == 3
    (tmp_path / "files" / "ab").mkdir(parents=True)
    (tmp_path / "files" / "ab" / "x.json").write_text('{"a": 1}')
    row = rawstore.read_raw(spark, f"{tmp_path}/files").first()
    assert row["payload"] == '{"a": 1}' and row["raw_path"].endswith("ab/x.json")


def test_station_file(spark, tmp_path):
    path = tmp_path / "stations.json"
    path.write_text("\n".join(json.dumps({"station_id": i, "icao": "" if i == "A" else i, "iata": " ", "city": "c"}) for i in "AB"))
    dim = {r["station_id"]: r for r in S.load_stations(spark, str(path), ("A", "B")).collect()}
    assert dim["A"]["icao"] == "A" and dim["B"]["iata"] is None
    with pytest.raises(ValueError, match="C"):
        S.load_stations(spark, str(path), ("A", "C"))


def test_features_come_from_the_chosen_run(spark):
    hours = spark.createDataFrame(
        [("S", run, "2024-05-01", f"2024-05-01 {h:02d}:00:00", t, 1.0) for run, t in (("early", 10.0), ("late", 99.0)) for h in (1, 2)],
        "station string, run string, date string, at string, temperature double, dew double",
    ).withColumn("at", F.col("at").cast("timestamp"))
    weather = W.run_features(hours, station="station", run="run", date="date", valid_time="at", temperature="temperature", features=["dew"])
    decisions = spark.createDataFrame([("S", "early", "2024-05-01"), ("S", "none", "2024-05-01")], "station string, run string, date string")
    got = {r["run"]: r for r in W.attach_weather(decisions, weather, ["station", "run", "date"]).collect()}
    assert got["early"]["forecast_daily_max_c"] == 10.0 and len(got["early"]["forecast_hourly"]) == 2
    assert got["none"]["weather_reject"] == "no weather for station and date"


def test_working_tables_are_released(spark):
    from pathlib import Path

    from bucketwise.sources import scratch

    rows = scratch.materialize(spark.range(5).toDF("i"), "numbers")
    path = Path(scratch._MADE[-1])
    assert rows.count() == 5 and path.exists()
    scratch.release(spark)
    assert not path.exists()


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_working_tables_leave_no_shuffle_files(spark):
    import time

    from bucketwise.sources import scratch

    before, setting = shuffle_files(spark), spark.conf.get(scratch._CLEANUP)
    counts = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    assert scratch.materialize(counts, "counts").count() == 1000
    end = time.time() + 20
    while shuffle_files(spark) > before + 4 and time.time() < end:  # the last count has one of its own
        time.sleep(0.2)
    assert shuffle_files(spark) <= before + 4
    assert spark.conf.get(scratch._CLEANUP) == setting
    assert sum(r["count"] for r in counts.toLocalIterator()) == 100_000 == sum(r["count"] for r in counts.toLocalIterator())


def test_lines_are_shuffled_once_a_key(spark):
    from bucketwise.plans.bindings import snapshot_lines

    plan = snapshot_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "l_orderkey" in joins[0] and sum("l_" in line for line in joins) == 2
    assert any("c_custkey" in line and line.index("Join") > joins[0].index("Join") for line in joins)


def test_snapshot_files_are_packed_and_ordered(spark, tmp_path):
    rows = spark.range(2000).select(
        F.concat(F.lit("c"), "id").alias("condition_id"), F.lit("t").alias("token_id"), F.lit("2024-01-01").alias("event_date"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 24 as int))").alias("decision_ts"),
        F.lit("Will the highest temperature be over ten degrees?").alias("question"),
    )
    files.write_snapshots_jsonl(rows, f"{tmp_path}/lines")
    files.write_snapshots_payload(rows, f"{tmp_path}/payload")
    lines, payload = spark.read.text(f"{tmp_path}/lines"), spark.read.parquet(f"{tmp_path}/payload")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    text = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    assert lines.count() == payload.count() == 2000
    assert 4 * size("lines") < text and 4 * size("payload") < text
    for part in sorted((tmp_path / "payload").glob("part-*")):
        keys = [json.loads(r.payload)["dedup_key"] for r in spark.read.parquet(str(part)).collect()]
        assert keys == sorted(keys)


def test_ordered_files_hold_each_row_once_in_apart_ranges(spark, tmp_path):
    import time

    from bucketwise.sources import scratch

    ids = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("n"))
    rows = ids.unionByName(ids.filter("n % 10 = 0")).repartition(5, "n").select(
        F.when(F.col("n") != 5, F.concat(F.lit("c"), "n")).alias("condition_id"), F.lit("t").alias("token_id"),
        F.lit("2024-01-01").alias("event_date"), F.expr("timestamp'2024-01-01'").alias("decision_ts"), F.lit(None).alias("nothing"),
    )
    before, tables = shuffle_files(spark), len(scratch._MADE)
    files.write_snapshots(rows.drop("nothing"), f"{tmp_path}/typed")
    files.write_snapshots_payload(rows, f"{tmp_path}/payload")
    files.write_snapshots_jsonl(rows, f"{tmp_path}/lines")
    assert len(scratch._MADE) == tables
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before  # also of what was read to write
    want = sorted(f"c{n}|t|2024-01-01|2024-01-01T00:00:00+00:00" if n != 5 else "t|2024-01-01|2024-01-01T00:00:00+00:00"
                  for n in [*range(3000), *range(0, 3000, 10)])
    parts = [[r.dedup_key for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "typed").glob("part-*")]
    parts = sorted((p for p in parts if p), key=lambda p: p[0])
    assert all(p == sorted(p) for p in parts) and [k for p in parts for k in p] == want
    payload = [json.loads(r.payload) for r in spark.read.parquet(f"{tmp_path}/payload").collect()]
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert sorted(r["dedup_key"] for r in payload) == sorted(r["dedup_key"] for r in lines) == want
    assert payload[0]["nothing"] is None and "nothing" in lines[0] and "_key" not in payload[0]
    with pytest.raises(FileExistsError):
        files.write_snapshots(rows.drop("nothing"), f"{tmp_path}/typed")
    files.write_snapshots(rows.drop("nothing").limit(0), f"{tmp_path}/empty")
    assert files.read_snapshots(spark, f"{tmp_path}/empty").count() == 0 and not list(tmp_path.glob("*-*"))


def test_stream_batches_use_every_core(spark, tmp_path, monkeypatch):
    from bucketwise.plans import table_queries

    monkeypatch.setattr(table_queries, "new_path", lambda _spark, name: f"{tmp_path}/{name}")
    table_queries.stream_upsert(spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "trades" / "input").glob("part-*"))) == 6 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "trades" / "checkpoint" / "commits").glob("[0-9]*"))) == 6


def test_stream_leaves_packed_files_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    import time

    from bucketwise.plans import table_queries

    monkeypatch.setattr(table_queries, "new_path", lambda _spark, name: f"{tmp_path}/{name}")
    before = shuffle_files(spark)
    table_queries.stream_upsert(spark, "/root/testdata/sf0.001")
    stored = [f for folder in ("input", "table") for f in (tmp_path / "trades" / folder).rglob("part-*.parquet")]
    assert len(stored) > 12 and all(f.name.endswith(".zstd.parquet") for f in stored)
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before


def test_unique_snapshots_are_chosen_before_their_texts_are_made(spark):
    from bucketwise.plans.bindings import snapshots_unique

    plan = snapshots_unique(spark, "/root/testdata/sf0.001").select("question", "slug")._jdf.queryExecution().optimizedPlan().toString()
    assert "Will the highest temperature" in plan.split("Window [")[0] and "Will the highest temperature" not in plan.split("Window [")[1]
