"""Mixing sources to target weights by pivotal dependent rounding.

A source's words are to be taken ``target / source size`` times. Every document gets the whole part of that as copies;
the fraction left is rounded so that the source's words are kept: two documents meet, words move from one to the other
until one of them is taken in full or not at all, the direction drawn so that each one's expected words stay as they
are, and the other goes on. Documents meet in blocks of about ``BLOCK`` by a hash of their id; every block leaves at most
one undecided document, blocks of these meet again, and so on up a tree, until one is left per source, which is drawn.
So a source misses its target by less than the size of that last document. In a block large documents come first, and
smaller ones settle them. Draws are hashes of ids and a seed, so reruns agree.

Only DataFrame functions run. A source of any size is spread over its blocks; totals are combined before the shuffle.
Only the list of sources is ordered as a whole.

Defined cases: null text has size 0; null is a source of its own, ordered last; rows without words are taken 0 times;
rows that repeat id, source and size are units of their own; a null id is an id like others; an empty table gives no
rows. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bucketwise.llm.textkit import WHITE_CLASS, only, table
from bucketwise.sources.scratch import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
#: smallest part of the last gap that a document may have that helps to close it
GAP_SHARE = 64


def word_count(text: Column) -> Column:
    """Number of words, in two passes over the text that build no list."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS.replace("[", "[^") + "+", "x")
    return F.length(F.regexp_replace(marked, WHITE_CLASS + "+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Shares by weight, none above ``most`` times the source. With sources ordered by limit / weight, those that stop at
    their limit come first; the level of the others is the first one at which nobody above is over the limit.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights)) + 1)
    ).select("*", limit.alias("limit"), (limit / F.col("weight")).alias("ratio"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, behind = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(behind),
    )
    # of equal ratios the first one, which has the highest level
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("minus")))).over(
        Window.partitionBy()
    )
    return leveled.select(
        *sizes.columns, F.least("limit", F.coalesce(-first["minus"], F.lit(0.0)) * F.col("weight")).alias("target")
    )


_UNIT = "named_struct('id', {0}.id, 'nth', {0}.nth, 'size', {0}.size, 'mass', {1})"
_ROUND = """
aggregate(
  members,
  named_struct('done', cast(array() as {done}), 'open', {nobody}),
  (acc, x) -> CASE
    WHEN acc.open IS NULL THEN named_struct('done', acc.done, 'open', x)
    -- draw: words go from the open one to x with probability back / (forth + back)
    WHEN {draw} * (least(acc.open.mass, x.size - x.mass) + least(x.mass, acc.open.size - acc.open.mass))
         < least(x.mass, acc.open.size - acc.open.mass)
    THEN CASE
      WHEN acc.open.mass <= x.size - x.mass
      THEN named_struct('done', array_append(acc.done, {open_out}), 'open', {x_gains})
      ELSE named_struct('done', array_append(acc.done, {x_in}), 'open', {open_loses}) END
    ELSE CASE
      WHEN x.mass <= acc.open.size - acc.open.mass
      THEN named_struct('done', array_append(acc.done, {x_out}), 'open', {open_gains})
      ELSE named_struct('done', array_append(acc.done, {open_in}), 'open', {x_loses}) END
  END)
"""


def _draw(seed: int, *ids: str) -> str:
    """Uniform in [0, 1) from ids."""
    return f"(pmod(xxhash64({', '.join(ids)}, {seed}), 1048576) / 1048576D)"


def _round(id_type: str, seed: int) -> Column:
    unit_type = f"struct<id:{id_type},nth:bigint,size:double,mass:double>"
    outcome = "named_struct('id', {0}.id, 'nth', {0}.nth, 'size', {0}.size, 'extra', {1})"
    return F.expr(_ROUND.format(
        done=f"array<struct<id:{id_type},nth:bigint,size:double,extra:int>>", nobody=f"cast(null as {unit_type})",
        draw=_draw(seed, "acc.open.id", "acc.open.nth", "x.id", "x.nth"),
        open_out=outcome.format("acc.open", 0), open_in=outcome.format("acc.open", 1),
        x_out=outcome.format("x", 0), x_in=outcome.format("x", 1),
        x_gains=_UNIT.format("x", "x.mass + acc.open.mass"), x_loses=_UNIT.format("x", "x.mass - (acc.open.size - acc.open.mass)"),
        open_gains=_UNIT.format("acc.open", "acc.open.mass + x.mass"),
        open_loses=_UNIT.format("acc.open", "acc.open.mass - (x.size - x.mass)"),
    ))


def _decided(units: DataFrame, seed: int) -> DataFrame:
    """(source, id, size, extra): copies beyond the whole ones, summed over the rows of an id.

    ``units``: source, id, nth, size, mass, blocks (of the source on this level of the tree).
    """
    id_type = units.schema["id"].dataType.simpleString()
    levels, most = [], units.agg(F.max("blocks")).first()[0] or 0
    level, last = 0, most == 0
    while not last:
        last = most <= 1
        member = F.struct("id", "nth", F.col("size").cast("double").alias("size"), "mass")
        first = F.struct((-F.col("size")).alias("by_size"), F.xxhash64("id", "nth", F.lit(seed)).alias("by_hash"), member.alias("unit"))
        grouped = (
            units.withColumn("block", F.pmod(F.xxhash64("id", "nth", F.lit(seed + level)), F.col("blocks")))
            .groupBy("source", "block", "blocks")
            .agg(F.transform(F.sort_array(F.collect_list(first)), lambda x: x["unit"]).alias("members"))
        )
        folded = materialize(
            grouped.select("source", "blocks", _round(id_type, seed + level).alias("r")).select("source", "blocks", "r.done", "r.open"),
            "rounded",
        )
        levels.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        units = folded.where("open is not null").select(
            "source", "open.*", F.ceil(F.col("blocks") / BLOCK).alias("blocks")
        )
        level, most = level + 1, -(-most // BLOCK)
    drawn = F.expr(f"{_draw(seed - 1, 'id', 'nth')} * size < mass").cast("int")
    last = materialize(
        units.select("source", "id", "nth", F.col("size").cast("double").alias("size"), "mass", drawn.alias("extra")), "drawn"
    )
    done = last.select("source", "id", "nth", "size", "extra")
    for part in levels:
        done = done.unionByName(part)
    settled = done.drop("nth").unionByName(
        _settled(done, last.select(F.col("source").alias("s"), (F.col("mass") - F.col("extra") * F.col("size")).alias("gap")), seed)
    )
    return settled.groupBy("source", "id", F.col("size").cast("long").alias("size")).agg(F.sum("extra").alias("extra"))


def _settled(done: DataFrame, gaps: DataFrame, seed: int) -> DataFrame:
    """(source, id, size, extra): a few smaller documents moved up or down to make good the last draw's gap.

    Per source some ``GAP_SHARE * 4`` documents between a ``GAP_SHARE``-th and a half of the gap are picked by hash, and
    the largest that still fit are moved, so what is left is a small part of the last document.
    """
    wide = F.abs(F.col("gap"))
    near = done.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("extra") == F.when(F.col("gap") > 0, 0).otherwise(1)) & F.col("size").between(wide / GAP_SHARE, wide / 2)
    )
    sums = near.groupBy("source").agg(F.sum("size").alias("all")).select(F.col("source").alias("s2"), "all")
    picked = (
        near.join(sums, F.col("source").eqNullSafe(F.col("s2")))
        .where(F.expr(f"{_draw(seed - 2, 'id', 'nth')} * all < 4 * abs(gap)"))
        .groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "id", "nth")), asc=False).alias("members"))
    )
    id_type = done.schema["id"].dataType.simpleString()
    kind = f"array<struct<size:double,id:{id_type},nth:bigint>>"
    fold = F.expr(
        f"aggregate(members, named_struct('left', abs(gap), 'moved', cast(array() as {kind})), (acc, x) -> "
        "IF(x.size <= acc.left, named_struct('left', acc.left - x.size, 'moved', array_append(acc.moved, x)), acc)).moved"
    )
    return picked.select("source", F.explode(fold).alias("m"), F.signum("gap").cast("int").alias("extra")).select(
        "source", "m.id", "m.size", "extra"
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return only(docs, id=id_col, source=source_col, size=word_count(docs[f"`{text_col}`"]))


def _plan(sized: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(one row per id, source and size: n rows, whole copies, extra copies in all; one row per source)."""
    rows = materialize(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = materialize(targets(
        rows.groupBy("source").agg(
            F.sum(F.col("size") * F.col("n")).alias("source_size"),
            F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("units"),
        )
    ), "sources")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = sources.select(
        F.col("source").alias("s"), times.alias("times"), F.floor(times).alias("whole"),
        F.ceil(F.col("units") / BLOCK).alias("blocks"),
    )
    rated = rows.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = rated.where("size > 0 and times > whole").select(
        "source", "id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"), "size",
        (F.col("size") * (F.col("times") - F.col("whole"))).alias("mass"), "blocks",
    )
    extra = _decided(units, seed).select(
        F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "extra"
    )
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    whole = F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long")
    plan = rated.join(extra, same, "left").select(
        "id", "source", "size", "n", whole.alias("whole"), F.coalesce("extra", F.lit(0)).alias("extra")
    )
    return plan, sources


def mix_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken."""
    plan, sources = _plan(_sized(docs, id_col, text_col, source_col), seed)
    per_source = sources.select(F.col("source").alias("s"), "source_size", "target")
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")
    return (
        plan.join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select("id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1
) -> DataFrame:
    """The mixed rows: every document as often as it is taken, with its columns and the number of the copy."""
    plan, _ = _plan(_sized(docs, id_col, text_col, source_col), seed)
    plan = plan.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "whole", "extra")
    wrapped = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"),
        docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"),
    )
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    nth = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("id"))
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")
    number = "copy"
    while number in docs.columns:
        number = f"mix_{number}"
    return (
        wrapped.join(plan.where("whole + extra > 0"), same).withColumn("nth", nth).withColumn("copies", copies)
        .where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(number))
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )
