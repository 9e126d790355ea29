"""Descriptive mispricing tables, backtest evaluation and tail bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.functions import classify as M
from bucketwise.functions.times import event_month, season


def with_model_probability(
    rows: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("event_key", "token_id")
) -> DataFrame:
    """Left lookup of model probabilities; rows without one keep null and are counted later."""
    return rows.join(
        predictions.select(*keys, F.col("probability").alias("model_p")), list(keys), "left"
    )


def valid_candidates(rows: DataFrame) -> DataFrame:
    """Rows with both probabilities, with their edge."""
    return rows.filter("model_p IS NOT NULL AND market_probability IS NOT NULL").withColumn(
        "edge", M.raw_edge(F.col("model_p"), F.col("market_probability"))
    )


def _stats() -> list[Column]:
    yes = F.count_if(M.is_yes(F.col("settlement_label")))
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.avg("model_p").alias("mean_model_probability"),
        F.avg("market_probability").alias("mean_market_probability"),
        F.avg("edge").alias("mean_raw_edge"),
        yes.alias("settled_yes_count"),
        (yes / n).alias("settled_yes_fraction"),
    ]


def fixed_bucket_stats(candidates: DataFrame, label: Column, labels: Sequence[str]) -> DataFrame:
    """Stats for every label in order; empty labels stay with n = 0 and null means."""
    spark = candidates.sparkSession
    dim = spark.createDataFrame(list(enumerate(labels)), "ordinal int, bucket string")
    stats = candidates.groupBy(label.alias("bucket")).agg(*_stats()).filter("bucket IS NOT NULL")
    # both sides hold at most one row per label
    return (
        F.broadcast(dim)
        .join(F.broadcast(stats), "bucket", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("settled_yes_count", F.coalesce("settled_yes_count", F.lit(0)))
    )


def group_stats(candidates: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(dimension, bucket, stats): all groupings in one pass with grouping sets."""
    cols = [c.alias(name) for name, c in groups.items()]
    names = list(groups)
    measures = ["model_p", "market_probability", "edge", "settlement_label"]
    wide = candidates.select(*cols, *measures)
    sets = [[F.col(n)] for n in names]
    grouped = wide.groupingSets(sets, *[F.col(n) for n in names]).agg(
        *[F.grouping(n).alias(f"_g_{n}") for n in names], *_stats()
    )
    dimension, bucket = None, None
    for n in names:
        hit = F.col(f"_g_{n}") == 0
        dimension = F.when(hit, n) if dimension is None else dimension.when(hit, n)
        bucket = F.when(hit, F.col(n)) if bucket is None else bucket.when(hit, F.col(n))
    return grouped.select(
        dimension.alias("dimension"), bucket.alias("bucket"), "n", "mean_model_probability",
        "mean_market_probability", "mean_raw_edge", "settled_yes_count", "settled_yes_fraction",
    )


def standard_groups() -> dict[str, Column]:
    def or_unknown(name: str) -> Column:
        return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit("unknown"))

    return {
        "city": or_unknown("city"),
        "station_icao": or_unknown("station_icao"),
        "event_month": event_month(F.col("event_date")),
        "season": season(F.col("event_date")),
        "bucket_region": M.bucket_region(F.col("bucket_kind")),
    }


def _valid() -> Column:
    return F.col("model_p").isNotNull() & F.col("market_probability").isNotNull()


def mispricing_summary(rows: DataFrame, split_name: str) -> DataFrame:
    ok = _valid()
    return rows.agg(
        F.count_if(ok).alias("valid_candidates"),
        F.count_if(~ok).alias("excluded_missing_model_or_market"),
        F.count_if(ok & F.col("forecast_lead_hours").isNull()).alias("missing_lead_hours_count"),
        F.avg(F.when(ok, F.col("model_p"))).alias("average_model_probability"),
        F.avg(F.when(ok, F.col("market_probability"))).alias("average_market_probability"),
        F.avg(F.when(ok, F.col("model_p") - F.col("market_probability"))).alias("average_raw_edge"),
    ).select(F.lit(split_name).alias("split_name"), "*")


def threshold_counts(
    rows: DataFrame, thresholds: Sequence[float] = C.EDGE_THRESHOLDS
) -> DataFrame:
    """(threshold, n): candidates whose edge reaches each threshold, one pass over the rows."""
    edge = M.raw_edge(F.col("model_p"), F.col("market_probability"))
    counts = rows.agg(*[F.count_if(edge >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n"))
          for i, t in enumerate(thresholds)]
    )
    return counts.select(F.inline(pairs))


def backtest_evaluation(
    rows: DataFrame, split_name: str, selected_threshold: float | None = None
) -> DataFrame:
    """One row per evaluation; economics stay null because fills are never simulated."""
    ok = _valid()
    edge = M.raw_edge(F.col("model_p"), F.col("market_probability"))
    can_trade = ok & F.col("best_ask").isNotNull()
    if selected_threshold is not None:
        can_trade = can_trade & (
            M.executable_edge(F.col("model_p"), F.col("best_ask")) >= selected_threshold
        )
    agg = rows.agg(
        F.count_if(ok).alias("candidates"),
        F.count_if(can_trade).alias("executable_trades"),
        F.avg(F.when(ok, F.col("market_probability"))).alias("average_descriptive_market_probability"),
        F.avg(F.when(ok, F.col("model_p"))).alias("average_model_probability"),
        F.avg(F.when(ok, edge)).alias("average_raw_edge"),
    )
    none = F.col("executable_trades") == 0
    nulls = [
        F.lit(None).cast("double").alias(c)
        for c in ("pnl", "roi", "max_drawdown", "profit_factor", "win_rate",
                  "average_executable_entry_price", "selected_threshold")
    ]
    return agg.select(
        F.when(none, "non_executable").otherwise("insufficient_data").alias("status"),
        F.when(
            none,
            "CLOB prices-history does not reconstruct historical asks; no executable trades; "
            "PnL/ROI/drawdown/profit factor remain null",
        )
        .otherwise("executable asks were present but fill simulation is out of scope")
        .alias("reason"),
        F.lit(split_name).alias("split_name"),
        *agg.columns,
        F.lit("not_applied_non_executable").alias("fees_mode"),
        *nulls,
    )


def tail_bands(rows: DataFrame) -> DataFrame:
    """Stats of the cheap bands; all bands present."""
    cheap = rows.filter("model_p IS NOT NULL").withColumn(
        "edge", M.raw_edge(F.col("model_p"), F.col("market_probability"))
    )
    stats = fixed_bucket_stats(
        cheap.filter(F.col("market_probability") < 0.05), M.tail_band(F.col("market_probability")),
        [name for name, _lo, _hi in C.TAIL_BANDS],
    )
    return stats.select(
        "ordinal", F.col("bucket").alias("band"), "n", "settled_yes_fraction",
        "mean_model_probability", "mean_raw_edge", "settled_yes_count",
    )


def max_band_share(bands: DataFrame) -> DataFrame:
    total = F.sum("settled_yes_count")
    return bands.agg(
        (F.max("settled_yes_count") / F.when(total != 0, total)).alias("max_band_settled_yes_share")
    )


def survival_state(rows: DataFrame, survival: Column, status: Column) -> DataFrame:
    """Adds state, resolved status and a reject reason; only three (flag, status) pairs are legal.

    A missing status is derived from the flag.
    """
    default = (
        F.when(survival.isNull(), C.SURVIVAL_STATUS[None])
        .when(survival, C.SURVIVAL_STATUS[True])
        .otherwise(C.SURVIVAL_STATUS[False])
    )
    state = (
        F.when(survival.isNull(), C.SURVIVAL_STATE[None])
        .when(survival, C.SURVIVAL_STATE[True])
        .otherwise(C.SURVIVAL_STATE[False])
    )
    resolved = F.coalesce(status, default)
    legal = resolved == default
    return rows.withColumns(
        {
            "survival_state": F.when(legal, state),
            "survival_status": resolved,
            "survival_reject": F.when(~legal, "invalid executable survival combination"),
        }
    )
