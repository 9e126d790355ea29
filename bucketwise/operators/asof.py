"""Point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bucketwise import constants as C
from bucketwise.operators.lanes import LANE_ROWS, last_before


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tolerance_seconds: int | None = None,
    first_seen: Sequence[str] = (),
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """Latest ``right`` row at or before ``left_ts`` per key; left rows without one keep nulls.

    A key with more than ``lane_rows`` rows is cut into lanes at quantiles of its own times; a lane gets one carried
    row from its past. Equal right timestamps collapse to the first in ``first_seen`` before the shuffle and repeated
    left (key, time) pairs are answered once. A null key matches nothing.
    """
    by = list(by)
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in by], F.lit(True))
    point = F.struct(F.col(right_ts).alias("ts"), *[F.col(v) for v in values])
    tie = F.struct(*[F.col(c) for c in first_seen]) if first_seen else F.col(right_ts)
    points = (
        right.filter(F.col(right_ts).isNotNull() & known)
        .groupBy(*by, F.unix_micros(right_ts).alias("_ts"))
        .agg(F.min_by(point, tie).alias("_pt"))
    )
    wanted = left.filter(F.col(left_ts).isNotNull() & known).select(*by, F.unix_micros(left_ts).alias("_ts"))
    hit = F.col("_pt")
    if tolerance_seconds is not None:
        hit = F.when(F.col("_ts") - F.unix_micros(F.col("_pt.ts")) <= tolerance_seconds * 1_000_000, hit)
    answers = last_before(wanted, points, by, "_ts", "_pt", lane_rows).select(
        *by, F.timestamp_micros("_ts").cast(left.schema[left_ts].dataType).alias(left_ts), hit.alias("_pt")
    )
    return left.join(answers, [*by, left_ts], "left").select(
        *[left[c] for c in left.columns],
        F.col("_pt.ts").alias(right_ts),
        *[F.col(f"_pt.{v}").alias(v) for v in values],
    )


def asof_price(
    decisions: DataFrame,
    prices: DataFrame,
    *,
    by: Sequence[str],
    decision_ts: str,
    observed_at: str,
    price: str,
    first_seen: Sequence[str] = (),
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """Bounded as-of price: only finite probabilities count, look-back seven days, inclusive."""
    p = F.col(price)
    valid = prices.filter(~F.isnan(p) & p.between(0.0, 1.0))
    return asof_join(
        decisions,
        valid,
        by=by,
        left_ts=decision_ts,
        right_ts=observed_at,
        values=[price],
        tolerance_seconds=C.PRICE_LOOKBACK_DAYS * 86_400,
        first_seen=first_seen,
        lane_rows=lane_rows,
    )


def latest_per_key(df: DataFrame, by: Sequence[str], ts: str, values: Sequence[str],
                   first_seen: Sequence[str] = ()) -> DataFrame:
    """Top-1 by time with map-side combine; equal times keep the first in ``first_seen``."""
    same = F.struct(*[F.col(c) for c in first_seen]) if first_seen else F.col(ts)
    row = F.struct(F.col(ts), *[F.col(v) for v in values])
    return (
        df.groupBy(*by, F.col(ts).alias("_ts"))
        .agg(F.min_by(row, same).alias("_row"))
        .groupBy(*by)
        .agg(F.max_by("_row", "_ts").alias("_row"))
        .select(*by, "_row.*")
    )


def lookahead_reason() -> Column:
    """First violated point-in-time rule of a snapshot row, null when the row is clean."""
    decision = F.col("decision_ts")
    return (
        F.when(F.col("weather_issued_at") > decision, C.LOOKAHEAD_ISSUED)
        .when(F.col("weather_available_at") > decision, C.LOOKAHEAD_AVAILABLE)
        .when(F.col("weather_available_at") < F.col("weather_issued_at"), C.LOOKAHEAD_ORDER)
        .when(F.col("market_price_observed_at") > decision, C.LOOKAHEAD_PRICE)
        .when(F.col("observation_as_of") > decision, C.LOOKAHEAD_OBSERVATION)
        .when(
            F.col("observation_max_so_far_c").isNotNull() & F.col("observation_as_of").isNull(),
            C.LOOKAHEAD_NO_STAMP,
        )
    )
