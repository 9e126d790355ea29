"""Overlapping intervals with a preference, cut into disjoint pieces.

The K distinct bounds of a key cut the number line into 2 K + 1 segments: 0 lies before the first bound, 2 k + 1 is the
bound number k itself and 2 k + 2 the stretch behind it. An interval covers a run of segments, and a run is the union of
at most two nodes per level of the binary tree over the segments. Each node keeps its least interval; the least of
a segment is the least over the nodes above it. Work is a few rows per interval (two per level at most, and an interval
between neighbouring bounds has one or two), whatever overlaps, and no key's intervals are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bucketwise.operators.lanes import last_before, running_total
from bucketwise.sources.scratch import materialize

_NODES = """filter(flatten(transform(
    transform(sequence(0, cast(floor(log2(_b - _a)) as int) + 1), l -> struct(
        l as level, shiftright(_a + shiftleft(1L, l) - 1, l) as a, shiftright(_b, l) as b)),
    x -> array(
        if(x.a < x.b and x.a % 2 = 1, struct(x.level as level, x.a as node), null),
        if(x.a < x.b and x.b % 2 = 1, struct(x.level as level, x.b - 1 as node), null)))), n -> n is not null)"""


def bounds(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, bound, k): the distinct bounds of every key, numbered from 0."""
    values = (
        spans.select(*by, F.explode(F.array("start", "end")).alias("bound")).where("bound is not null").distinct()
    )
    return running_total(materialize(values, "bounds"), by, "bound", F.lit(1).cast("long"), "k").withColumn("k", F.col("k") - 1)


def nodes(spans: DataFrame, numbered: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, level, node, winner): the least ``order`` of the intervals that hold a tree node of their own.

    ``spans``: by, start, start_open, end, end_open, order; a null start or end is unbounded.
    """
    by = list(by)
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    placed = (
        spans.join(numbered.select(*by, F.col("bound").alias("start"), F.col("k").alias("_start")), [*by, "start"], "left")
        .join(numbered.select(*by, F.col("bound").alias("end"), F.col("k").alias("_end")), [*by, "end"], "left")
        .join(sizes, by, "left")
        .withColumn("_a", F.when(F.col("start").isNull(), 0).otherwise(2 * F.col("_start") + 1 + F.col("start_open").cast("int")).cast("long"))
        .withColumn("_b", F.when(F.col("end").isNull(), 2 * F.coalesce("_size", F.lit(0)) + 1)
                    .otherwise(2 * F.col("_end") + 2 - F.col("end_open").cast("int")).cast("long"))
        .where("_a < _b")
    )
    return placed.select(*by, order, F.inline(F.expr(_NODES))).groupBy(*by, "level", "node").agg(F.min(order).alias("winner"))


def winners(segments: DataFrame, tree: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, segment, winner) of the segments that an interval covers. ``tree``: the table of :func:`nodes`."""
    by = list(by)
    depth = tree.groupBy(*by).agg(F.max("level").alias("_depth"))
    above = (
        segments.join(depth, by).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_depth"))))
        .withColumn("node", F.expr("shiftright(segment, level)"))
    )
    return above.join(tree, [*by, "level", "node"]).groupBy(*by, "segment").agg(F.min("winner").alias("winner"))


def segment_of(values: DataFrame, numbered: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, segment) of the distinct values: the bound at or before a value says where it lies."""
    by = list(by)
    right = numbered.select(*by, F.col("bound").alias(value), F.struct("k", "bound").alias("_hit"))
    asked = values.select(*by, value).where(F.col(value).isNotNull()).distinct()
    hits = last_before(asked, right, by, value, "_hit")
    segment = 2 * F.col("_hit.k") + F.when(F.col("_hit.bound") == F.col(value), 1).otherwise(2)
    return asked.join(hits, [*by, value], "left").select(*by, value, F.coalesce(segment, F.lit(0)).cast("long").alias("segment"))
