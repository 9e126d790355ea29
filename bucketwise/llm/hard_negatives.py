"""Hard negatives by a secondary sort of pair scores.

An anchor's pairs are packed into binary keys that sort as (anchor, score descending, positives first, id), dealt out by
anchor and sorted within partitions, so one pass over a partition meets every anchor's pairs from the best one on. The
pass holds the open windows of one anchor, five at most: a positive opens one, a negative goes into every open window
that it is still hard enough for, and a window closes when it is full or the scores have fallen below it.

Scores come from blocks. The rows are cut into slices and the anchors into blocks; every (block, slice) is one group of
bounded size, scored by one matrix product, and only pairs that can still win leave it: the best positives of the slice
first, then, once the windows are known, the first negatives of each window. Both kinds of pairs meet in the same
sort, whose volume is a few pairs per anchor and slice however large a label is.

The score is the inner product of integer vectors, exact: products run in doubles where no sum can reach 2^53, in
Python integers elsewhere, and stay within a long at its ends.

Defined cases: rows with a null id, label or vector, or a null component take no part. A shorter vector counts as
ending in zeros. Rows that repeat an id at the same score count once; "other rows" are those with another id. Anchors
that share an id but not label or vector are mined one by one; equal anchors once. An anchor without positives, or
a window without negatives, gives no rows. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import only, table
from bucketwise.sources.scratch import materialize

ANCHOR_BLOCK = 8192
ROW_SLICE = 8192
POSITIVES = 5
NEGATIVES = 5
LOWER, UPPER = 80, 100

_TILE = 256
_LONG = np.iinfo(np.int64)
_KEY = struct.Struct(">QQQBQ")
_FLIP = 1 << 63
_PAIR = "anchor long, tag long, key binary"


def pack(anchor: int, tag: int, score: int, negative: bool, other: int) -> bytes:
    """A key that sorts as (anchor, tag, score descending, positives first, id)."""
    return _KEY.pack(anchor + _FLIP, tag + _FLIP, _FLIP - 1 - score, negative, other + _FLIP)


def unpack(key: bytes) -> tuple[int, int, int, bool, int]:
    anchor, tag, score, negative, other = _KEY.unpack(key)
    return anchor - _FLIP, tag - _FLIP, _FLIP - 1 - score, bool(negative), other - _FLIP


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros; doubles instead where these hold every value exactly."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs, cut at the ends of a long."""
    def most(x: np.ndarray) -> int:
        return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))

    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` allowed entries of each row by falling score, then id; an (id, score) counts once."""
    masked = np.where(allowed, scores, _LONG.min)
    if scores.shape[1] > k:
        # repeats of one id could fill the first k, so the threshold is taken over more where ids repeat
        level = k if len(np.unique(ids)) == len(ids) else scores.shape[1]
        floor = np.partition(masked, scores.shape[1] - level, axis=1)[:, scores.shape[1] - level]
        allowed = allowed & (scores >= floor[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -scores[row, col].astype(np.float64), row))
    if len(row) and np.abs(scores[row, col]).max() >= 1 << 53:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(scores[row[i], col[i]]), ids[col[i]])), int)
    row, col = row[order], col[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]]) | (scores[row[1:], col[1:]] != scores[row[:-1], col[:-1]])
    row, col = row[fresh], col[fresh]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors of the tile, scores, ids of the rows, same label) for runs of anchors against all rows of the slice."""
    wide = [t.column("vec").combine_chunks() for t in (anchors, rows)]
    width = max([1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in wide)])
    left, right = (_vectors(c, width) for c in wide)
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    own = anchors.column("label").to_numpy()
    for first in range(0, len(left), _TILE):
        part = slice(first, first + _TILE)
        yield part, _products(left[part], right), ids, own[part, None] == labels[None, :]


def _emit(anchors: pa.Table, found: list[tuple]) -> pa.Table:
    """Pairs (place of the anchor, score, negative, id) as keys."""
    ids, tags = anchors.column("id").to_pylist(), anchors.column("tag").to_pylist()
    keys = [pack(ids[i], tags[i], score, negative, other) for i, score, negative, other in found]
    return pa.table({
        "anchor": pa.array([ids[f[0]] for f in found], pa.int64()), "tag": pa.array([tags[f[0]] for f in found], pa.int64()),
        "key": pa.array(keys, pa.binary()),
    })


def _positives_of(count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found, names = [], anchors.column("id").to_numpy()
        for part, scores, ids, same in _tiles(anchors, rows) if len(anchors) and len(rows) else ():
            i, j = _best(scores, ids, same & (ids[None, :] != names[part, None]), count)
            found += zip((i + part.start).tolist(), scores[i, j].tolist(), [False] * len(i), ids[j].tolist(), strict=True)
        return _emit(anchors, found)
    return run


def _negatives_of(count: int, lower: int, upper: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found, windows = set(), anchors.column("windows").to_pylist()
        for part, scores, ids, same in _tiles(anchors, rows) if len(anchors) and len(rows) else ():
            own = windows[part]
            for k in range(max(map(len, own), default=0)):
                has = np.array([k < len(w) for w in own])
                low, high = (np.array(x, np.int64) for x in zip(*(bounds(w[k], lower, upper) if k < len(w) else (1, 0) for w in own), strict=True))
                inside = ~same & has[:, None] & (scores >= low[:, None]) & (scores <= high[:, None])
                i, j = _best(scores, ids, inside, count)
                found |= set(zip((i + part.start).tolist(), scores[i, j].tolist(), [True] * len(i), ids[j].tolist(), strict=True))
        return _emit(anchors, sorted(found))
    return run


def bounds(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """Least and greatest integer score with lower * positive <= 100 * score <= upper * positive."""
    low, high = -((-lower * positive) // 100), upper * positive // 100
    return max(low, int(_LONG.min) + 1), min(high, int(_LONG.max))


@dataclass
class _Window:
    positive: int
    score: int
    low: int
    high: int
    taken: list[tuple[int, int]] = field(default_factory=list)


def stream(keys: Iterator[bytes], positives: int, negatives: int, lower: int, upper: int) -> Iterator[tuple]:
    """Sorted keys to (anchor, tag, positive, rank, negative, positive's score, negative's score).

    Holds the windows of one anchor only. With ``negatives`` 0 the windows themselves come out, without ranks.
    """
    anchor, last, windows, opened = None, None, [], 0
    for key in keys:
        if key == last:
            continue
        last = key
        name, tag, score, negative, other = unpack(key)
        if (name, tag) != anchor:
            anchor, windows, opened = (name, tag), [], 0
        windows = [w for w in windows if len(w.taken) < negatives and score >= w.low]
        if not negative:
            if opened < positives:
                opened += 1
                if not negatives:
                    yield name, tag, other, None, None, score, None
                else:
                    windows.append(_Window(other, score, *bounds(score, lower, upper)))
            continue
        for w in windows:
            if score <= w.high:
                w.taken.append((other, score))
                yield name, tag, w.positive, len(w.taken), other, w.score, score


_FOUND = (
    "anchor_id long, tag long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def _sorted_stream(pairs: DataFrame, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    """The pairs dealt out by anchor, sorted by packed key within partitions and streamed once."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        held: list[tuple] = []
        keys = (key for b in batches for key in b.column("key").to_pylist())
        for found in stream(keys, positives, negatives, lower, upper):
            held.append(found)
            if len(held) == 8192:
                yield batch(held)
                held = []
        yield batch(held)

    dealt = pairs.repartition("anchor", "tag").sortWithinPartitions("key").select("key")
    return dealt.mapInArrow(run, _FOUND)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
    anchor_block: int = ANCHOR_BLOCK, row_slice: int = ROW_SLICE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on the column ``id``. An anchor's positives are the first ``positives`` other rows of its
    label; for each, the first ``negatives`` rows of other labels whose score lies between ``lower`` and ``upper`` per
    cent of the positive's. Labels and vector components must be whole numbers.
    """
    spark = rows.sparkSession
    usable = (
        only(rows, id=id_col, label=label_col, vec=vector_col)
        .where("id is not null and label is not null and vec is not null and forall(vec, x -> x is not null)")
        .select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"))
    )
    n, n_anchors = usable.agg(F.count("*"), F.count_if(is_anchor)).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices, blocks = max(width, math.ceil(n / row_slice)), max(1, math.ceil(n_anchors / anchor_block))
    # the number in a file scan is the same when a lost task runs again
    dealt = usable.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int"))
    # a row goes to every block of anchors, an anchor to every slice of rows
    spread = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "slice")
    anchors = usable.where(is_anchor).distinct().toDF("id", "label", "vec").withColumn("tag", F.xxhash64("label", "vec"))

    def paired(chosen: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        placed = chosen.withColumn("block", F.pmod(F.xxhash64("id", "tag", F.lit(1)), F.lit(blocks)).cast("int"))
        copies = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        copies = copies.toDF(*copies.columns)  # names of their own beside the rows
        return copies.groupBy("block", "slice").cogroup(spread).applyInArrow(score, _PAIR)

    near = _sorted_stream(paired(anchors, _positives_of(positives)), positives, 0, lower, upper)
    opened = materialize(near.select("anchor_id", "tag", "positive_id", "positive_score"), "windows")
    windows = opened.groupBy(F.col("anchor_id").alias("id"), "tag").agg(F.collect_list("positive_score").alias("windows"))
    hard = paired(anchors.join(windows, ["id", "tag"]), _negatives_of(negatives, lower, upper))
    keys = opened.select(
        F.col("anchor_id").alias("anchor"), "tag", _packed(F.col("anchor_id"), F.col("tag"), F.col("positive_score"), F.col("positive_id")).alias("key")
    )
    return _sorted_stream(hard.unionByName(keys), positives, negatives, lower, upper).drop("tag")


def _packed(anchor: Column, tag: Column, score: Column, other: Column) -> Column:
    """:func:`pack` of a positive as an expression."""
    def flipped(x: Column) -> Column:
        return F.unhex(F.lpad(F.hex(x.bitwiseXOR(F.lit(_LONG.min).cast("long"))), 16, "0"))

    return F.concat(flipped(anchor), flipped(tag), flipped(F.bitwise_not(score)), F.unhex(F.lit("00")), flipped(other))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100. A seventh of the labels is moved on by one; components become floor(256 x)."""
    x = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = x.where(finite).select(
        "vec_id", moved.alias("label"), F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("embedding")
    )
    return mine(rows, F.col("id") % 100 == 0)


SQL = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        [floor(256 * x::double)::bigint for x in embedding] as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
), pairs as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)])::bigint as score
    from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, other_id as positive_id, score as positive_score from pairs where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id,
    row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id)::integer as rank,
    n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score
qualify rank <= 5
"""
