"""Keyed tables: trades, books, upserts, counts, files and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.functions.classify import is_yes
from bucketwise.operators import keyed as K, merge, normalize as N
from bucketwise.plans.bindings import (
    SEQ_COLUMNS, hourly, hourly_sql, market_sql, price_payloads, snapshot_sql, snapshots,
    snapshots_unique, table,
)
from bucketwise.plans.registry import SQL, query, rounded
from bucketwise.plans.text_queries import raw_markets
from bucketwise.sources import rawstore, snapshots as files
from bucketwise.sources.scratch import new_path, shuffles_end
from bucketwise.streaming.ingest import ingest_stream, read_judged

SEQ_SQL = ", ".join(SEQ_COLUMNS)
B1, B5 = snapshot_sql(), market_sql()

TRADE_FIELDS = {
    "id": "CASE WHEN l_linenumber = 7 THEN 'x' || l_orderkey END",
    "transactionHash": "'0h' || l_orderkey",
    "conditionId": "CASE WHEN l_linenumber = 2 THEN NULL ELSE '0x' || l_orderkey END",
    "market": "CASE WHEN l_orderkey % 10 = 0 THEN 'abc' || l_orderkey ELSE '0x' || l_orderkey END",
    "asset": "CASE WHEN l_suppkey % 29 = 0 THEN ' ' ELSE 'a' || l_suppkey END",
    "side": "CASE l_returnflag WHEN 'N' THEN '' WHEN 'A' THEN 'BUY' ELSE 'SELL' END",
    "price": "CASE WHEN l_partkey % 37 = 0 THEN 'NaN' ELSE {t}(l_discount) END",
    "size": "CASE WHEN l_partkey % 43 = 0 THEN 'many' ELSE {t}(l_quantity) END",
    "outcome": "CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' END",
    "outcomeIndex": "{t}(l_linenumber)",
}


def raw_trades(df: DataFrame) -> DataFrame:
    """Order lines as raw trade records, all fields text."""
    cols = [F.expr(sql.format(t="string")).alias(n) for n, sql in TRADE_FIELDS.items()]
    stamp = F.when(F.col("l_partkey") % 41 != 0, F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string"))
    return df.select(*cols, stamp.alias("timestamp"), F.struct(*SEQ_COLUMNS).alias("seq"))


def _sql_text(x: str) -> str:
    return x.replace("{t}(l_discount)", "cast(l_discount AS varchar)").replace("{t}(l_quantity)", "cast(l_quantity AS varchar)").replace(
        "{t}(l_linenumber)", "cast(l_linenumber AS varchar)")


def _digest() -> str:
    names = sorted(N.TRADE_ID_FIELDS)
    parts = [f"'{n}=' || CASE WHEN \"{n}\" IS NULL THEN '{{}}' ELSE '{{\"v\":\"' || \"{n}\" || '\"}}' END" for n in names]
    return "sha256(" + " || chr(1) || ".join(parts) + ")"


TRADE_SQL = (
    "t0 AS (SELECT " + ", ".join(f'{_sql_text(sql)} AS "{n}"' for n, sql in TRADE_FIELDS.items())
    + f", CASE WHEN l_partkey % 41 <> 0 THEN cast(cast(epoch(l_shipdate) AS bigint) AS varchar) END AS \"timestamp\", {SEQ_SQL} FROM lineitem), "
    + f"t1 AS (SELECT *, coalesce(id, {_digest()}) AS trade_id FROM t0), "
    + f"t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY {SEQ_SQL}) AS k FROM t1 WHERE market LIKE '0x%') WHERE k = 1), "
    + """t3 AS (SELECT *, nullif(trim(asset), '') AS tok, CASE WHEN price <> 'NaN' THEN try_cast(price AS double) END AS pr, try_cast("size" AS double) AS sz FROM t2),
t4 AS (SELECT *, CASE WHEN "timestamp" IS NULL THEN 'skipped trade: missing timestamp' WHEN tok IS NULL OR pr IS NULL OR sz IS NULL THEN
    'skipped trade: missing or invalid required field(s) ' || concat_ws(', ', CASE WHEN tok IS NULL THEN 'asset' END,
    CASE WHEN pr IS NULL THEN 'price' END, CASE WHEN sz IS NULL THEN 'size' END) END AS reject_reason FROM t3)"""
)


@query(
    "trades_normalize",
    f"""WITH {TRADE_SQL} SELECT trade_id, tok AS token_id, CASE WHEN side = '' THEN 'UNKNOWN' ELSE side END AS side, round(pr, 6) AS price, sz AS size,
    strftime(to_timestamp(cast("timestamp" AS bigint)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS traded_at, "transactionHash" AS transaction_hash,
    coalesce("conditionId", market) AS condition_id, outcome AS outcome_label FROM t4 WHERE reject_reason IS NULL""",
)
def trades_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, _rejects = N.normalize_trades(raw_trades(table(spark, sf_dir, "lineitem")), ["seq"])
    return rounded(trades.withColumn("traded_at", F.date_format("traded_at", "yyyy-MM-dd'T'HH:mm:ss")))


@query("trade_rejects", f"WITH {TRADE_SQL} SELECT reject_reason, count(*) AS n FROM t4 WHERE reject_reason IS NOT NULL GROUP BY 1")
def trade_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _trades, rejects = N.normalize_trades(raw_trades(table(spark, sf_dir, "lineitem")), ["seq"])
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("trade_identity", f"WITH {TRADE_SQL} SELECT trade_id, count(*) AS copies FROM t1 GROUP BY 1")
def trade_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketwise.functions.identity import trade_id

    raw = raw_trades(table(spark, sf_dir, "lineitem"))
    ident = trade_id({f: F.col(f) for f in N.TRADE_ID_FIELDS}, [F.col("id")])
    return raw.groupBy(ident.alias("trade_id")).agg(F.count(F.lit(1)).alias("copies"))


# ---- order books --------------------------------------------------------------------------------------

def book_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book document per order, two bids and two asks, some of them unusable."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def level(price, size):
        return F.struct(price.cast("string").alias("price"), size.cast("string").alias("size"))

    bids = F.array(
        level(F.when(key % 5 == 0, F.lit("bad")).otherwise((cust % 100 / 100).cast("string")), key % 9),
        level(F.lit("0"), F.lit("0")),
    )
    asks = F.array(
        level((cust % 50 / 50), F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("3"))),
        level(F.lit("0.99"), cust % 11),
    )
    doc = F.struct(
        F.when(key % 4 != 0, F.concat(F.lit("a"), cust)).alias("asset_id"),
        F.when(key % 23 != 0, (F.unix_seconds("o_orderdate") * 1000).cast("string")).alias("timestamp"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("hash"),
        F.lit("0.01").alias("tick_size"), bids.alias("bids"), asks.alias("asks"),
    )
    return o.select(key, F.concat(F.lit("a"), cust).alias("token"), F.to_json(doc).alias("payload"))


@query(
    "book_levels",
    """WITH o AS (SELECT *, 'a' || o_custkey || ':' || cast(epoch(o_orderdate) * 1000 AS bigint) AS snapshot_id FROM orders WHERE o_orderkey % 23 <> 0)
    SELECT snapshot_id, 'bid' AS side, 0 AS level_index, round((o_custkey % 100) / 100, 6) AS price, cast(o_orderkey % 9 AS double) AS size FROM o WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT snapshot_id, 'bid', 1, 0.0, 0.0 FROM o
    UNION ALL SELECT snapshot_id, 'ask', 0, round((o_custkey % 50) / 50, 6), 3.0 FROM o WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT snapshot_id, 'ask', 1, 0.99, cast(o_custkey % 11 AS double) FROM o""",
)
def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _snapshots, levels = N.flatten_books(book_payloads(spark, sf_dir), "token")
    return rounded(levels)


# ---- upserts ------------------------------------------------------------------------------------------

@query(
    "upsert_latest",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipped
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {', '.join(c + ' DESC' for c in SEQ_COLUMNS if c != 'l_shipdate')}) AS k
      FROM lineitem) WHERE k = 1""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    version = ["l_shipdate", *[c for c in SEQ_COLUMNS if c != "l_shipdate"]]
    out = K.upsert(
        lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus <> 'F'"), ["l_orderkey", "l_linenumber"], version
    )
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )


BOOK_PARENT_SQL = """bp AS (SELECT 'b' || o_orderkey AS snapshot_id, 'a' || o_custkey AS token_id, date_trunc('year', o_orderdate) AS observed,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS hash, o_orderkey AS version, o_totalprice FROM orders),
bw AS (SELECT *, row_number() OVER k AS last, first_value(snapshot_id) OVER (PARTITION BY token_id, observed, coalesce(hash, '') ORDER BY version) AS first_id
  FROM bp WINDOW k AS (PARTITION BY token_id, observed, coalesce(hash, '') ORDER BY version DESC))"""


@query(
    "upsert_children",
    f"""WITH {BOOK_PARENT_SQL} SELECT first_id AS snapshot_id, token_id, hash, version, unnest([0, 1]) AS level_index,
    round(o_totalprice, 2) AS price FROM bw WHERE last = 1""",
)
def upsert_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _books(spark, sf_dir)
    kept, levels = K.upsert_with_children(
        parents, children, natural_key=["token_id", "observed", "hash"], id_col="snapshot_id",
        version=["version"],
    )
    return kept.join(levels, "snapshot_id").select(
        "snapshot_id", "token_id", "hash", "version", "level_index", F.round("price", 2).alias("price")
    )


@query("merge_latest", SQL["upsert_latest"])
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table takes the delta in two merges; each rewrites the buckets it touches."""
    lines, path = table(spark, sf_dir, "lineitem"), new_path(spark, "lines")
    version = ["l_shipdate", *[c for c in SEQ_COLUMNS if c != "l_shipdate"]]
    keys = ["l_orderkey", "l_linenumber"]
    base = lines.filter("l_linestatus = 'F'")
    merge.create(K.first_per_key(base, keys, [F.col(c).desc() for c in version]), path, keys, buckets=32)
    for part in ("l_linestatus <> 'F' and l_orderkey % 2 = 0", "l_linestatus <> 'F' and l_orderkey % 2 <> 0"):
        merge.upsert_into(path, lines.filter(part), version)
    return merge.read(spark, path).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parents = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), "o_orderkey").alias("snapshot_id"), F.concat(F.lit("a"), "o_custkey").alias("token_id"),
        F.date_trunc("year", "o_orderdate").alias("observed"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("hash"),
        F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"),
    )
    children = parents.select(
        "snapshot_id", "version", F.explode(F.array(F.lit(0), F.lit(1))).alias("level_index"), "price"
    )
    return parents.drop("price"), children


@query("merge_children", SQL["upsert_children"])
def merge_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books arrive in three writes by version; parents and their levels are merged into stored tables."""
    parents, children = _books(spark, sf_dir)
    home = new_path(spark, "books")
    merge.create(parents.limit(0), f"{home}/parents", ["token_id", "observed", "hash"], buckets=32)
    merge.create(children.drop("version").limit(0), f"{home}/levels", ["snapshot_id"], buckets=32)
    edges = parents.agg(F.percentile_approx("version", [0.4, 0.8]).alias("v")).first()["v"] or [0, 0]
    place = F.when(F.col("version") <= edges[0], 0).when(F.col("version") <= edges[1], 1).otherwise(2)
    for i in range(3):
        merge.upsert_parents_into(
            f"{home}/parents", f"{home}/levels", parents.where(place == i), children.where(place == i), id_col="snapshot_id", version=["version"]
        )
    kept, levels = merge.read(spark, f"{home}/parents"), merge.read(spark, f"{home}/levels")
    return kept.join(levels, "snapshot_id").select(
        "snapshot_id", "token_id", "hash", "version", "level_index", F.round("price", 2).alias("price")
    )


COUNT_TABLES = {
    "markets": "orders", "outcomes": "lineitem", "price_snapshots": "events", "trades": "lineitem",
    "order_book_snapshots": "orders", "hourly_observations": "events", "raw_payloads": "pages",
}


@query(
    "table_counts",
    " UNION ALL ".join(f'SELECT \'{n}\' AS "table", count(*) AS n FROM {t}' for n, t in COUNT_TABLES.items()),
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table_counts({n: table(spark, sf_dir, t) for n, t in COUNT_TABLES.items()})


@query(
    "market_iteration",
    f"WITH {B5} SELECT coalesce(condition_id, 'unknown:' || id) AS condition_id, question FROM b5 ORDER BY 1",
)
def market_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.normalize_markets(raw_markets(spark, sf_dir)).select("condition_id", "question")
    return rows.orderBy("condition_id")


@query(
    "discovery_union",
    f"""WITH {B5} SELECT o_orderkey, coalesce(condition_id, id) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'search' ELSE 'listing' END AS found_by FROM b5""",
)
def discovery_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_markets(spark, sf_dir).select("o_orderkey", F.coalesce("conditionId", "id").alias("key"))
    search = raw.filter("o_orderkey % 2 = 0").withColumn("found_by", F.lit("search"))
    listing = raw.withColumn("found_by", F.lit("listing"))
    return K.union_first([search, listing], ["key"], ["o_orderkey"])


# ---- stream ----------------------------------------------------------------------------------------------

@query(
    "stream_upsert",
    f"""WITH {TRADE_SQL} SELECT trade_id, tok AS token_id, round(pr, 6) AS price, sz AS size, coalesce("conditionId", market) AS condition_id
    FROM t4 WHERE reject_reason IS NULL""",
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades arrive in six triggers, each of as many files as the cluster has cores; the result is that of one batch."""
    home, cores = new_path(spark, "trades"), spark.sparkContext.defaultParallelism
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    with shuffles_end(spark):
        lines.repartition(6 * cores, F.col("l_orderkey"), F.col("l_linenumber")).write.option("compression", "zstd").parquet(f"{home}/input")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", cores).parquet(f"{home}/input")

    def judge(batch: DataFrame) -> DataFrame:
        return N.judge_trades(raw_trades(batch), ["seq"])

    ingest_stream(source, f"{home}/table", f"{home}/checkpoint", judge, ["trade_id"], ["seq"], compact_every=4)
    current, _ = N.split_judged(read_judged(spark, f"{home}/table"), ["seq"])
    return rounded(current.select("trade_id", "token_id", "price", "size", "condition_id"))


# ---- files -------------------------------------------------------------------------------------------------

ROUND_TRIP_SQL = f"""WITH {B1} SELECT token_id, event_date, city, round(market_probability, 6) AS market_probability, event_id,
    nullif(trim(bucket_label), '') AS bucket_label, strftime(decision_ts, '%Y-%m-%dT%H:%M:%S') AS decision_ts,
    strftime(weather_issued_at, '%Y-%m-%dT%H:%M:%S') AS weather_issued_at, provenance_urls[1] AS first_url, 0 AS n_limitations FROM b1u"""


def _trip(df: DataFrame) -> DataFrame:
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return rounded(
        df.select(
            "token_id", "event_date", "city", "market_probability", "event_id",
            F.nullif(F.trim("bucket_label"), F.lit("")).alias("bucket_label"),
            F.date_format("decision_ts", fmt).alias("decision_ts"),
            F.date_format("weather_issued_at", fmt).alias("weather_issued_at"),
            F.get("provenance_urls", F.lit(0)).alias("first_url"), F.size("limitations").alias("n_limitations"),
        )
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_unique(spark, sf_dir).drop("seq", "identity", "event_key", "raw_weight", "order_ts", "n_nationkey")


@query("snapshot_jsonl_roundtrip", ROUND_TRIP_SQL)
def snapshot_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshots-jsonl")
    files.write_snapshots_jsonl(_stored(spark, sf_dir), path)
    return _trip(files.read_snapshots_jsonl(spark, path))


@query("snapshot_payload_roundtrip", ROUND_TRIP_SQL)
def snapshot_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshots-payload")
    files.write_snapshots_payload(_stored(spark, sf_dir), path)
    return _trip(files.read_snapshots_payload(spark, path))


@query("snapshot_parquet_roundtrip", ROUND_TRIP_SQL)
def snapshot_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshots")
    none = F.array().cast("array<string>")
    files.write_snapshots(_stored(spark, sf_dir).withColumn("limitations", none), path)
    return _trip(files.read_snapshots(spark, path))


@query(
    "hourly_decode",
    f"""WITH {hourly_sql()} SELECT 'S' || station_no AS station_id, strftime(hour, '%Y-%m-%dT%H:%M:%S') AS valid_time,
    round(temperature_c, 6) AS temperature_c, round(dew_point_c, 6) AS dew_point_c, round(wind_speed, 6) AS wind_speed FROM
    (SELECT station_no, hour, temperature_c, dew_point_c, CASE WHEN station_no % 2 = 0 THEN wind_speed END AS wind_speed FROM b4)""",
)
def hourly_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir)
    stamp = F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    as_object = F.to_json(
        F.struct(stamp.alias("valid_time_utc"), "temperature_c", "dew_point_c", "wind_speed"),
        {"ignoreNullFields": "false"},
    )
    number = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("temperature_c", "dew_point_c")]
    as_list = F.concat(F.lit('["'), stamp, F.lit('",'), number[0], F.lit(","), number[1], F.lit("]"))
    item = F.when(F.col("station_no") % 2 == 0, as_object).otherwise(as_list)
    h = files.hourly_state(item)
    return rounded(
        rows.select(F.concat(F.lit("S"), "station_no").alias("station_id"), h.alias("h")).select(
            "station_id", F.date_format("h.valid_time_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("valid_time"),
            "h.temperature_c", "h.dew_point_c", "h.wind_speed",
        )
    )


@query(
    "quarantine_scan",
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unspecified' ELSE 'r' || o_orderkey % 5 END AS reason, 'c' || o_orderkey AS condition_id,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS details FROM orders""",
)
def quarantine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    item = F.to_json(
        F.struct(
            F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("r"), F.col("o_orderkey") % 5)).alias("reason"),
            F.concat(F.lit("c"), "o_orderkey").alias("condition_id"),
            F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("details"),
        )
    )
    path = new_path(spark, "quarantine-json")
    # every order is one JSON array with one reject and one stray scalar
    o.select(F.lit(1).alias("g"), item.alias("j")).select(
        F.concat(F.lit("[7,"), "j", F.lit("]")).alias("value")
    ).write.text(path)
    lines = spark.read.text(path)
    rows = files.quarantine_from_documents(lines)
    return rows.select("reason", "condition_id", "details")


@query(
    "quarantine_log",
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unspecified' ELSE 'unknown station ' || o_orderkey % 50 END AS reason,
    'c' || o_orderkey AS condition_id, o_orderpriority AS details FROM orders""",
)
def quarantine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("unknown station "), F.col("o_orderkey") % 50))
    path = new_path(spark, "quarantine-log")
    rows = o.select(reason.alias("reason"), F.concat(F.lit("c"), "o_orderkey").alias("condition_id"), F.col("o_orderpriority").alias("details"))
    for odd in (0, 1):  # two appends
        files.write_quarantine(rows.where(F.substring("condition_id", -1, 1).cast("int") % 2 == odd), path)
    return files.read_quarantine_log(spark, path)


@query("raw_store")
def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price documents by content address, stored twice; the second pass adds nothing."""
    docs = price_payloads(spark, sf_dir).select(
        F.lit("prices/history").alias("source"),
        F.concat(F.lit("https://api.example.com/h?token="), "token_id", F.lit("&doc="), "payload_id").alias("url"),
        "payload", F.lit(1).alias("version"),
    )
    addressed = rawstore.address_payloads(docs, source="source", url="url", payload="payload")
    store = new_path(spark, "raw")
    rawstore.store_payloads(spark, addressed, store)
    held = rawstore.store_payloads(spark, addressed, store)
    return held.select("request_url", "content_sha256", "raw_path", F.length("payload").alias("n_chars"))


@query(
    "settled_sorted",
    f"""WITH {B1} SELECT event_date, token_id, condition_id FROM b1u WHERE lower(settlement_label) = 'yes' ORDER BY 1, 2, 3""",
)
def settled_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots_unique(spark, sf_dir).filter(is_yes(F.col("settlement_label")))
    return rows.select("event_date", "token_id", "condition_id").orderBy("event_date", "token_id", "condition_id")
