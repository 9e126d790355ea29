"""Edges, bands and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bucketwise import constants as C


def is_valid_probability(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))


def finite_number(text: Column) -> Column:
    """Finite double from text, null for blanks, words, NaN and infinities; zero stays."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite_double(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def raw_edge(model_p: Column, market_p: Column) -> Column:
    return model_p - market_p


def executable_edge(model_p: Column, ask: Column) -> Column:
    return model_p - ask


def edge_bucket(edge: Column) -> Column:
    return (
        F.when(edge <= 0.0, "<=0%")
        .when(edge <= 0.05, "0-5%")
        .when(edge <= 0.10, "5-10%")
        .when(edge <= 0.15, "10-15%")
        .when(edge <= 0.20, "15-20%")
        .when(edge.isNotNull(), ">20%")
    )


def price_bucket(price: Column) -> Column:
    return (
        F.when(price < 0.01, "<1c")
        .when(price < 0.03, "1-3c")
        .when(price < 0.05, "3-5c")
        .when(price < 0.10, "5-10c")
        .when(price <= 0.25, "10-25c")
        .when(price.isNotNull(), ">25c")
    )


def lead_bucket(hours: Column) -> Column:
    return (
        F.when(hours > 48.0, ">48h")
        .when(hours > 24.0, "24-48h")
        .when(hours > 12.0, "12-24h")
        .when(hours > 6.0, "6-12h")
        .when(hours >= 1.0, "1-6h")
        .when(hours.isNotNull(), "<1h")
    )


def tail_band(price: Column) -> Column:
    band = None
    for name, low, high in C.TAIL_BANDS:
        hit = (price >= low) & (price < high)
        band = F.when(hit, name) if band is None else band.when(hit, name)
    return band


def bucket_region(kind: Column) -> Column:
    return (
        F.when(kind.isin("below", "above"), "tail")
        .when(kind.isin("exact", "range"), "center")
        .otherwise("unknown")
    )


def settlement_degree(value: Column) -> Column:
    """Whole degree, halves away from zero, computed on the binary value as stated."""
    return F.when(value >= 0, F.floor(value + 0.5)).otherwise(F.ceil(value - 0.5))


def is_yes(label: Column) -> Column:
    return F.coalesce(F.lower(label) == "yes", F.lit(False))
