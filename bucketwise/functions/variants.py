"""Typed access to schemaless JSON through Spark's variant type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from bucketwise.functions.times import parse_instant

NUMBER_TYPES = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def is_kind(value: Column, path: str | None, *kinds: str) -> Column:
    """Is the value one of OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL? False when the path is absent.

    Containers are told by a cast that reads none of their content; only scalars are asked for their schema, once.
    """
    target = value if path is None else F.try_variant_get(value, path, "variant")
    at = "$" if path is None else path
    names: list[str] = []
    found = []
    for kind in kinds:
        if kind == "OBJECT":
            found.append(F.try_variant_get(value, at, "struct<a: boolean>").isNotNull())
        elif kind == "ARRAY":
            found.append(F.try_variant_get(value, at, "array<boolean>").isNotNull())
        elif kind == "NULL":
            found.append(F.is_variant_null(target))
        else:
            names += NUMBER_TYPES if kind == "NUMBER" else [kind]
    if names:
        name = F.substring_index(F.schema_of_variant(target), "(", 1)
        found.append(F.coalesce(name.isin(*names), F.lit(False)))
    return reduce(lambda x, y: x | y, found)


def has(value: Column, path: str) -> Column:
    """Does the path hold anything, JSON null included? A container is not copied to see it."""
    return is_kind(value, path, "OBJECT", "ARRAY") | F.try_variant_get(value, path, "variant").isNotNull()


def items(value: Column, path: str) -> Column:
    """Array elements as variants; empty when the path holds no array."""
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")
    )


def text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def finite_or_null(value: Column) -> Column:
    """JSON null, a number, or text holding a finite number; booleans and words are not."""
    number = F.trim(F.try_variant_get(value, "$", "string")).try_cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))
    return value.isNull() | is_kind(value, None, "NULL") | (is_kind(value, None, "NUMBER", "STRING") & finite)


def is_finite(value: Column) -> Column:
    return finite_or_null(value) & is_kind(value, None, "NUMBER", "STRING")


def valid_instant(value: Column, path: str) -> Column:
    number = is_kind(value, path, "NUMBER")
    word = is_kind(value, path, "STRING") & parse_instant(text(value, path)).isNotNull()
    return number | word


def valid_probability(value: Column, path: str) -> Column:
    p = F.trim(text(value, path)).try_cast("double")
    inside = F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))
    return is_kind(value, path, "NUMBER", "STRING") & inside


def first_text(texts: Column) -> Column:
    """First non-null element."""
    return F.get(F.array_compact(texts), F.lit(0))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
