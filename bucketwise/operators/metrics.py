"""Scoring of predicted bucket probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.functions.classify import is_yes


def brier_by_event(rows: DataFrame, key: str, p: str, y: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))


def multiclass_brier(rows: DataFrame, key: str, p: str, y: str) -> DataFrame:
    """Mean over events of the summed squared error; same as total over number of events."""
    return brier_by_event(rows, key, p, y).agg(F.avg("brier").alias("multiclass_brier"))


def log_loss_term(p: Column, clip: float = C.LOG_LOSS_CLIP) -> Column:
    return -F.log(F.least(F.lit(1.0 - clip), F.greatest(F.lit(clip), p)))


def clipped_log_loss(rows: DataFrame, p: str, y: str, clip: float = C.LOG_LOSS_CLIP) -> DataFrame:
    return rows.filter(F.col(y) == 1).agg(
        F.avg(log_loss_term(F.col(p), clip)).alias("clipped_log_loss")
    )


def calibration_bin(p: Column, bins: int = C.CALIBRATION_BINS) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), (p * bins).cast("int")))


def expected_calibration_error(
    rows: DataFrame, p: str, y: str, bins: int = C.CALIBRATION_BINS
) -> DataFrame:
    """Weighted gap between mean probability and outcome rate over fixed bins."""
    per_bin = rows.groupBy(calibration_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("avg_p"), F.avg(y).alias("avg_y")
    )
    gap = F.col("n") * F.abs(F.col("avg_p") - F.col("avg_y"))
    return per_bin.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def sums_to_one(p: Column, tol: float = C.PROBABILITY_TOLERANCE) -> Column:
    """Aggregate: no value below -tol and the total within tol of one."""
    return F.coalesce(F.bool_and(p >= -tol) & (F.abs(F.sum(p) - 1.0) <= tol), F.lit(False))


def event_scores(rows: DataFrame, key: str, model_p: str, baseline_p: str) -> DataFrame:
    """Labelled rows to one row per event with its skip reason (null = scored) and error terms."""
    yes = is_yes(F.col("settlement_label"))
    y = yes.cast("int")
    labelled = rows.filter("settlement_label IS NOT NULL")

    def terms(p: str, name: str) -> list[Column]:
        col = F.col(p)
        return [
            sums_to_one(col).alias(f"{name}_ok"),
            F.sum(F.pow(col - y, F.lit(2))).alias(f"{name}_brier"),
            F.sum(F.when(yes, log_loss_term(col))).alias(f"{name}_log"),
        ]

    per_event = labelled.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(yes).alias("n_yes"),
        F.count_if(F.col(model_p).isNull() | F.col(baseline_p).isNull()).alias("n_missing"),
        *terms(model_p, "model"),
        *terms(baseline_p, "baseline"),
    )
    skip = (
        F.when(F.col("n_yes") == 0, "zero YES winners")
        .when(F.col("n_yes") > 1, "multiple YES winners")
        .when(F.col("n_missing") > 0, "missing model or baseline probabilities")
        .when(
            ~F.col("model_ok") | ~F.col("baseline_ok"), "probabilities missing or not normalized"
        )
    )
    return per_event.withColumn("skip_reason", skip)


def skip_reasons(scores: DataFrame) -> DataFrame:
    return scores.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("events")
    )


def _paired_calibration(rows: DataFrame, model_p: str, baseline_p: str, y: Column) -> DataFrame:
    """One row (model_ece, baseline_ece): both curves in one pass over the rows."""
    curves = F.array(
        F.struct(F.lit("model").alias("who"), F.col(model_p).alias("p")),
        F.struct(F.lit("baseline").alias("who"), F.col(baseline_p).alias("p")),
    )
    long = rows.select(y.alias("y"), F.inline(curves))
    per_bin = long.groupBy("who", calibration_bin(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("avg_p"), F.avg("y").alias("avg_y")
    )
    gap = F.col("n") * F.abs(F.col("avg_p") - F.col("avg_y"))

    def ece(who: str) -> Column:
        mine = F.col("who") == who
        return (F.sum(F.when(mine, gap)) / F.sum(F.when(mine, F.col("n")))).alias(f"{who}_ece")

    return per_bin.agg(ece("model"), ece("baseline"))


SKIP_REASONS = (
    "missing model or baseline probabilities", "multiple YES winners",
    "probabilities missing or not normalized", "zero YES winners",
)


def score_split(rows: DataFrame, key: str, model_p: str, baseline_p: str) -> DataFrame:
    """One row: counts, skip reasons and the four metrics for model and baseline."""
    scores = event_scores(rows, key, model_p, baseline_p)
    scored = F.col("skip_reason").isNull()

    def mean(term: str) -> Column:
        return F.avg(F.when(scored, F.col(term)))

    counts = [F.count_if(F.col("skip_reason") == r).alias(f"_skip{i}")
              for i, r in enumerate(SKIP_REASONS)]
    summary = scores.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(scored).alias("scored_events"),
        F.count_if(~scored).alias("skipped_events"),
        mean("model_brier").alias("model_brier"),
        mean("model_log").alias("model_log_loss"),
        mean("baseline_brier").alias("baseline_brier"),
        mean("baseline_log").alias("baseline_log_loss"),
        F.bool_and(F.when(scored, F.col("model_ok"))).alias("model_sum_ok"),
        F.bool_and(F.when(scored, F.col("baseline_ok"))).alias("baseline_sum_ok"),
        *counts,
    )
    texts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_skip{i}") > 0,
                    F.concat(F.lit(f"{r} ("), F.col(f"_skip{i}").cast("string"), F.lit(")")),
                )
                for i, r in enumerate(SKIP_REASONS)
            ]
        )
    )
    kept = rows.filter("settlement_label IS NOT NULL").join(
        scores.filter(scored).select(key), key, "left_semi"
    )
    calibration = _paired_calibration(
        kept, model_p, baseline_p, is_yes(F.col("settlement_label")).cast("int")
    )
    status = F.when(F.col("scored_events") > 0, "ok").otherwise("insufficient_data")
    reason = F.when(F.col("n") == 0, "no settlement labels").when(
        F.col("scored_events") == 0, "no scorable events after winner/probability checks"
    )
    # both sides have exactly one row
    return (
        summary.withColumn("skip_reasons", texts)
        .drop(*[f"_skip{i}" for i in range(len(SKIP_REASONS))])
        .join(calibration)
        .select(status.alias("status"), reason.alias("reason"), "*")
    )


def sample_sufficiency(scored: DataFrame, minimum: int = C.MIN_SCORED_EVENTS) -> DataFrame:
    low = F.col("scored_events") < minimum
    return scored.select(
        F.when(low, "insufficient").otherwise("meets_operational_minimum").alias("status"),
        F.when(low, "inconclusive").otherwise("descriptive_only").alias("conclusion"),
        "scored_events",
        F.lit(minimum).alias("operational_minimum_scored_events"),
    )


def bucket_coverage(rows: DataFrame) -> DataFrame:
    """Distinct labels of labelled rows, as rows."""
    return (
        rows.filter("settlement_label IS NOT NULL")
        .select(F.coalesce("bucket_label", F.lit("")).alias("bucket_label"))
        .distinct()
    )
