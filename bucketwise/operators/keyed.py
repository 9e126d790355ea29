"""Keyed selection: first-seen, latest, upsert. All forms keep one hot key off a single task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bucketwise import constants as C
from bucketwise.sources.scratch import materialize


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """First row of every key in ``order``.

    Spark limits each map partition to one row per key before the shuffle (WindowGroupLimit), so a
    key with very many copies sends at most one row per input partition.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_row_id(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a table with a number ``_row`` of their own: narrow columns can be judged apart and joined back."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), name)


def first_rows(rows: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """``_row`` of the first row of every key: a map-side combined minimum over key, order and row number."""
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.select(
        *[c.alias(n) for n, c in zip(names, _cols(keys), strict=True)], F.struct(*_cols(order), F.col("_row")).alias("_at")
    )
    return narrow.groupBy(*names).agg(F.min("_at").alias("_at")).select("_at._row")


def flag_first_seen(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """Adds ``is_first``; keeps every row.

    The winners are chosen on key, order and row number alone; only the flag is joined back, by row number, so wide
    rows are shuffled once and no task sees the copies of a hot key.
    """
    rows = with_row_id(df)
    firsts = first_rows(rows, keys, order).withColumn("_first", F.lit(True))
    return rows.join(firsts, "_row", "left").withColumn("is_first", F.col("_first").isNotNull()).drop("_row", "_first")


def split_first_seen(
    df: DataFrame, keys: Sequence, order: Sequence
) -> tuple[DataFrame, DataFrame]:
    """(first rows, all later copies)."""
    flagged = flag_first_seen(df, keys, order)
    return (
        flagged.filter("is_first").drop("is_first"),
        flagged.filter("NOT is_first").drop("is_first"),
    )


def union_first(sources: Sequence[DataFrame], keys: Sequence, order: Sequence) -> DataFrame:
    """Union-distinct by key: earlier sources win, then ``order`` inside a source."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    bag = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(bag, keys, ["_source", *order]).drop("_source")


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], version: Sequence
) -> DataFrame:
    """Last write wins for all non-key columns; null key parts count as equal empty values."""
    bag = base.unionByName(delta, allowMissingColumns=True)
    null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    latest = [c.desc() for c in _cols(version)]
    return first_per_key(bag, null_safe, latest)


def upsert_with_children(
    parents: DataFrame,
    children: DataFrame,
    *,
    natural_key: Sequence[str],
    id_col: str,
    version: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Keep the last parent per natural key under the id first given to that key, and only the
    children that came with the winning write.

    ``children`` carry ``id_col`` and the version columns of the write they belong to.
    """
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}")
            for i, k in enumerate(natural_key)]
    names = [f"_k{i}" for i in range(len(natural_key))]
    keyed = parents.select("*", *keys)
    stamp = F.struct(*version, id_col)
    surviving = keyed.groupBy(*names).agg(
        F.min_by(F.col(id_col), stamp).alias("_first_id"), F.max(stamp).alias("_last")
    )
    winners = (
        keyed.join(surviving, names)
        .filter(stamp == F.col("_last"))
        .drop("_last", *names)
    )
    winners = first_per_key(winners, [id_col, *version], ["_first_id"])
    levels = (
        children.join(winners.select(id_col, *version, "_first_id"), [id_col, *version])
        .withColumn(id_col, F.col("_first_id"))
        .drop("_first_id", *version)
    )
    kept = winners.withColumn(id_col, F.col("_first_id")).drop("_first_id")
    return kept, levels


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for an allow-listed set of tables."""
    unknown = sorted(set(tables) - set(C.KEYED_TABLES))
    if unknown:
        raise ValueError(f"unknown table: {unknown}")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: Sequence) -> DataFrame:
    """Number of keys that occur more than once (not the number of surplus rows)."""
    named = [c.alias(f"_k{i}") for i, c in enumerate(_cols(keys))]
    counts = df.select(*named).groupBy(*[f"_k{i}" for i in range(len(named))]).count()
    return counts.agg(F.count_if(F.col("count") > 1).alias("duplicates"))


def missing_ids(spark: SparkSession, required: Sequence[str], df: DataFrame, col: str) -> DataFrame:
    """Required ids that the table does not hold."""
    want = spark.createDataFrame([(r,) for r in required], "required_id string")
    return want.join(
        df.select(F.upper(F.col(col)).alias("required_id")), "required_id", "left_anti"
    )
