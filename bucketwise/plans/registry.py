"""Query catalogue: name, Spark callable and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.sources.scratch import session_settings

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # naive stamps in the tables are UTC wall times
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            session_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so both engines print the same value."""
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def means(df: DataFrame) -> DataFrame:
    """As :func:`rounded`, with a hair added so that exact ties of averages round alike."""
    return df.select(
        *[
            F.round(F.col(f.name) + 1e-9, 6).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
