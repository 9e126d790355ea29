"""Line dedup by content-defined chunks of lines.

Hashes of lines roll over a document, two at a time, blank ones between them passed over. Where their value occurs
more than once in all documents a chunk begins, and it goes on as long as the value does: the borders depend on the
lines inside only, so a passage is cut alike wherever it stands, whatever was inserted before it, and from its first
line to its last. A line of more than ``LONG_WORDS`` words is a window by itself, so that a passage without line breaks
counts like one with them. Of every repeated window the first occurrence (least id, then place) stays; the lines of
all others go, blank ones inside a window too.

Bytes decide: a window's value is its lines' hashes, and the different texts of every hash are counted over all
documents. Where a hash has one text, equal hashes are equal bytes; windows with any other hash are compared as texts.

Only DataFrame functions run. Every different line is shuffled once, after each task has dropped its repeats; windows
travel as hashes and places. A hot window's occurrences meet its first one in a join that Spark can split.

Defined cases: null text is empty, and its result is empty; blank lines alone are no window; where an occurrence overlaps
the first one, the first one's lines stay; a null id ranks last; rows that repeat id and text are one document and
come back equal; an empty table gives no rows; other columns take no part. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import WHITE_CLASS, only, table
from bucketwise.sources.scratch import materialize

#: a line of more words is a passage by itself
LONG_WORDS = 50
_DOC, _VALUE = ["rank", "tag"], ["a", "b", "paired"]
_LAST = (1 << 63) - 1
_FULL = "[^" + WHITE_CLASS[1:]


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def _placed(base: DataFrame) -> DataFrame:
    """rank, tag and the full lines with their places."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return base.select("rank", "tag", F.filter(lines, lambda e: e["line"].rlike(_FULL)).alias("lines"))


def _windows(placed: DataFrame) -> DataFrame:
    """rank, tag, at, last, and the value a, b, paired of the windows of two full lines, and of the long lines."""
    # a long line has a letter and a space per word at least, which most lines lack
    alone = lambda x: (F.length(x) > 2 * LONG_WORDS) & (F.regexp_count(x, F.lit(_FULL + "+")) > LONG_WORDS)
    hashed = placed.select(
        "rank", "tag",
        F.transform("lines", lambda e: F.struct(e["at"].alias("at"), line_key(e["line"]).alias("key"), alone(e["line"]).alias("alone"))).alias("lines"),
    )

    def window(first: Column, last: Column, b: Column, paired: bool) -> Column:
        return F.struct(first["at"].alias("at"), last["at"].alias("last"), first["key"].alias("a"), b.alias("b"), F.lit(paired).alias("paired"))

    following = F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1)))
    pairs = F.zip_with("lines", following, lambda x, y: F.when(y.isNotNull(), window(x, y, y["key"], True)))
    found = F.concat(
        F.filter(pairs, lambda w: w.isNotNull()),
        F.transform(F.filter("lines", lambda e: e["alone"]), lambda e: window(e, e, F.lit(0).cast("long"), False)),
    )
    return hashed.select("rank", "tag", F.explode(found).alias("w")).select("rank", "tag", "w.*")


def _marks(gone: Column) -> Column:
    """An array with true at the places of the sorted array ``gone``, as long as the last of them needs."""
    before = F.concat(F.array(F.lit(-1)), gone)
    return F.flatten(F.zip_with(
        gone, F.slice(before, F.lit(1), F.size(gone)),
        lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True))),
    ))


def _with_text(windows: DataFrame, base: DataFrame) -> DataFrame:
    """The windows with the bytes of their lines in place of their hashes."""
    lines = F.split("text", "\n", -1)
    body = F.when(F.col("paired"), F.concat_ws("\n", F.get(lines, "at"), F.get(lines, "last"))).otherwise(F.get(lines, "at"))
    return base.join(windows, _DOC).select(*_DOC, "at", "last", body.alias("body"))


def _repeated(base: DataFrame) -> DataFrame:
    """rank, tag, gone: the sorted places of lines that are removed."""
    placed = _placed(base)
    keys = materialize(_windows(placed).groupBy(_VALUE).agg(F.count("*").alias("n")).where("n > 1").select(_VALUE), "keys")
    texts = placed.select(F.explode("lines.line").alias("line")).select(line_key(F.col("line")).alias("key"), "line")
    shared = materialize(texts.groupBy("key").agg(F.countDistinct("line").alias("n")).where("n > 1").select("key"), "shared-keys")
    flags = [shared.select(F.col("key").alias(c), F.lit(True).alias(f"odd_{c}")) for c in ("a", "b")]
    odd = F.col("odd_a").isNotNull() | F.col("odd_b").isNotNull()
    # a row that repeats gives the same places again, which are the first one's or counted once below
    found = _windows(placed).join(keys.hint("merge"), _VALUE, "left_semi").join(flags[0], "a", "left").join(flags[1], "b", "left")
    judged = materialize(found.withColumn("odd", odd).drop("odd_a", "odd_b"), "windows")
    place = F.struct(*_DOC, "at", "last")
    places = [*_DOC, "at", "last", "first"]
    # tables of their own, so that the joins have two plain exchanges and Spark can split a hot window
    sure = judged.where(~F.col("odd"))
    groups = materialize(sure.groupBy(_VALUE).agg(F.min(place).alias("first")), "groups")
    unsure = materialize(judged.where("odd").select(*_DOC, "at", "last", "paired").distinct(), "unsure")
    read = materialize(_with_text(unsure, base), "read")
    by_text = materialize(read.groupBy("body").agg(F.min(place).alias("first")), "by-text")
    later = (
        sure.join(groups.hint("merge"), _VALUE).select(*places)
        .unionByName(read.join(by_text, "body").select(*places))
    )
    own = (F.col("rank") == F.col("first.rank")) & (F.col("tag") == F.col("first.tag"))
    start = F.when(own, F.greatest("at", F.col("first.last") + 1)).otherwise(F.col("at"))
    return (
        later.where(~own | (F.col("at") != F.col("first.at"))).withColumn("start", start).where("start <= last")
        .groupBy(_DOC).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "last"))))).alias("gone"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text without repeated passages, n_lines and n_removed (lines) of every document."""
    rows = only(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    # a document is its id and a hash, so that no two of a large corpus share a name
    base = rows.withColumn("rank", F.coalesce("id", F.lit(_LAST))).withColumn("tag", F.xxhash64("text", F.lit(1), "id"))
    gone = materialize(_repeated(base), "gone")
    marked = F.zip_with(
        F.split("text", "\n", -1), _marks(F.col("gone")), lambda line, m: F.struct(line.alias("line"), F.coalesce(m, F.lit(False)).alias("gone"))
    )
    kept = F.transform(F.filter(marked, lambda e: ~e["gone"]), lambda e: e["line"])
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # a merge join at every size: both sides grow with the corpus
    return base.join(gone.hint("merge"), _DOC, "left").select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
f AS (SELECT doc_id, i, line, lead(i) OVER w AS j, lead(line) OVER w AS next FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i, j, line || chr(10) || next AS body FROM f WHERE j IS NOT NULL UNION ALL
      SELECT doc_id, i, i, line FROM f WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
r AS (SELECT *, first_value(doc_id) OVER w AS d1, first_value(i) OVER w AS i1, first_value(j) OVER w AS j1 FROM u
      WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d1 THEN greatest(i, j1 + 1) ELSE i END, j + 1)) AS i
      FROM r WHERE doc_id <> d1 OR i <> i1)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text,
       count(*) AS n_lines, count(g.i) AS n_removed
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
