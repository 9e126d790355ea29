"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is thrown into one of T bins and offers the bin the value (i, hash); a bin keeps the
least. Rounds 0 to T-1 throw at random, rounds T to 2T-1 throw everything into bin i-T, so every coordinate fills, and
most documents are done after one or two rounds. Two sets agree in a coordinate with the probability of their
similarity. Bands of four coordinates are hashed into buckets.

Documents with the same shingle set (equal digests of the sorted set) are one node, so thousands of copies cost one
sketch. Links are then confirmed on full shingle sets, in three passes that never emit all pairs of a bucket:

1. every node with one pivot, the one it shares most buckets with (the pivot of a bucket is a pseudo-random member);
2. every node with the other pivots of its buckets, where pass 1 has not connected the two;
3. what is left: members of one bucket that are still in different components.

Pass 3 makes the search complete: a pair that shares a bucket is verified, already connected, or ruled out by proof, so
no component is lost. The proof is a parity bitmap per set: every shingle flips one of 1,024 bits, so two bitmaps differ
in no more bits than the sets differ in shingles. It stands in the join's condition, so pairs it rules out are never
emitted. With 32 bands a pair at the threshold 0.85 shares no bucket with a probability of 6e-11, at 0.8 of 5e-8.

Defined cases: null or blank text has no shingles and links with nothing; a text of fewer words than a shingle is one
shingle; a null id is in no group, has component null and stays. Of rows that repeat an id with other texts each has its
own class, named by the least id of its texts' group; so one of them may go and another stay. A component's least id may then
belong to a row of another class as well, and a row stays if its id names its own class. An empty table gives no
rows. Other columns take no part. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.llm.components import components
from bucketwise.llm.textkit import byte_rows, mix, only, pieces, seeds, sets_of, shingle_hashes, table, word_hashes
from bucketwise.sources.scratch import materialize

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: longs of a parity bitmap
LANES = 16
#: throws made at once for a small set
BATCH = 1024

BITS = tuple(f"b{i}" for i in range(LANES))

_U = np.uint64
_ROUND = seeds(2 * BINS, 4711)
_BAND = seeds(BANDS, 97)
_LANE = seeds(ROWS, 31)


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set of distinct hashes; every coordinate is filled."""
    out = np.full(BINS, np.iinfo(np.uint64).max, dtype=_U)
    n, done = len(items), 0
    while done < BINS:
        rounds = np.arange(done, min(BINS, done + max(1, BATCH // n)))
        thrown = mix(items[None, :] ^ _ROUND[rounds][:, None])
        value = (rounds.astype(_U)[:, None] << _U(56)) | (thrown >> _U(8))
        np.minimum.at(out, (thrown % _U(BINS)).astype(np.int64).ravel(), value.ravel())
        done = int(rounds[-1]) + 1
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for empty in np.flatnonzero(out == np.iinfo(np.uint64).max):
        thrown = mix(items ^ _ROUND[BINS + empty])
        out[empty] = (_U(BINS + empty) << _U(56)) | (thrown.min() >> _U(8))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    folded = (mix(coordinates).reshape(BANDS, ROWS) * _LANE).sum(axis=1)
    return mix(folded + _BAND).view(np.int64)


def _sketches(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = sets_of(*shingle_hashes(*word_hashes(*byte_rows(batch.column("text"))), words))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_keys(sketch(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("raw"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "raw", "size", "digest", "bands"],
            )
    return run


def parity(items: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(items) >> _U(54)).astype(np.int64), minlength=64 * LANES).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _full_sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = sets_of(*shingle_hashes(*word_hashes(*byte_rows(batch.column("text"))), words))
            items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            bits = np.array([parity(x) for x in sets]).reshape(len(sets), LANES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), items, pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, bits.T)],
                names=["node", "items", "n", *BITS],
            )
    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "u").join(right, "v")
        .where(small * 100 >= large * percent)
        .where(both * 100 >= (F.size("a") + F.size("b") - both) * percent)
        .select("u", "v")
    )


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining the components that the links connect."""
    u = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    v = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    moved = components(links.join(u, "u").join(v, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    return materialize(
        labels.join(moved, labels["label"] == moved["node"], "left").select(
            labels["node"], F.coalesce("component", "label").alias("label")
        ),
        "labels",
    )


def _hung(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after following each node's link to its pivot twice; nodes of one label are connected."""
    up = links.select(F.col("node").alias("n1"), F.col("pivot").alias("p1"))
    further = links.select(F.col("node").alias("n2"), F.col("pivot").alias("p2"))
    return (
        nodes.join(up, F.col("node") == F.col("n1"), "left").join(further, F.col("p1") == F.col("n2"), "left")
        .select("node", F.coalesce("p2", "p1", "node").alias("label"))
    )


def _side(placed: DataFrame, prefix: str) -> DataFrame:
    return placed.select(*[F.col(c).alias(prefix + c) for c in placed.columns])


def _may_link(percent: int) -> Column:
    """False only where the bitmaps and sizes prove that sides u and v are not similar enough."""
    apart = sum((F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))).cast("long") for b in BITS), F.lit(0).cast("long"))
    both = F.least((F.col("u_n") + F.col("v_n") - apart) / 2, F.col("u_n"), F.col("v_n"))
    return both * 100 >= (F.col("u_n") + F.col("v_n") - both) * percent


def _across(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The pairs of different labels that may link; ``placed``: node, label, n and bitmap."""
    u, v = _side(placed, "u_"), _side(placed, "v_")
    joined = pairs.join(u, F.col("u") == F.col("u_node")).join(v, F.col("v") == F.col("v_node"))
    return joined.where(F.col("u_label") != F.col("v_label")).where(_may_link(percent)).select("u", "v")


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """(pivot, node, n): nodes with the pivots of their buckets and the number of buckets shared.

    The pivot is the least ``node xor mask`` with a mask per bucket, so it differs from bucket to bucket.
    """
    mask = F.xxhash64("bucket")
    pivots = buckets.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("x")).select(
        "bucket", F.col("x").bitwiseXOR(mask).alias("pivot")
    )
    return (
        buckets.join(pivots, "bucket").where("node <> pivot")
        .groupBy("pivot", "node").agg(F.count("*").alias("n"))
    )


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, raw (a hash of the text), kept."""
    rows = only(docs, id=id_col, text=text_col).withColumn("raw", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketches = materialize(
        rows.mapInArrow(_sketches(words), "id long, raw long, size long, digest binary, bands array<long>"), "sketches"
    )
    named = sketches.where("id is not null and digest is not null")
    owners = _named_nodes(named)
    banded = owners.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    buckets = materialize(banded.join(crowded.select("bucket"), "bucket"), "buckets")
    nodes = materialize(buckets.select("node").distinct(), "nodes")
    holders = owners.select("node", "id", "raw").join(nodes, "node")
    sets = materialize(
        rows.join(holders, ["id", "raw"]).select("node", "text").mapInArrow(
            _full_sets(words), "node long, items array<long>, n long, " + ", ".join(f"{b} long" for b in BITS)
        ),
        "sets",
    )
    marks = sets.drop("items")
    starred = materialize(_pivot_pairs(buckets), "pairs")
    best = starred.groupBy("node").agg(F.max_by("pivot", "n").alias("pivot"))
    first = materialize(_linked(best.select(F.col("pivot").alias("u"), F.col("node").alias("v")), sets, percent), "links")
    placed = _hung(nodes, first.select(F.col("u").alias("pivot"), F.col("v").alias("node"))).join(marks, "node")
    second = _linked(_across(_ordered(starred), placed, percent), sets, percent)
    labels = _merge(nodes.withColumn("label", F.col("node")), first.unionByName(second))
    third = _linked(_rest(buckets, labels.join(marks, "node"), percent), sets, percent)
    return _result(sketches, owners.select("digest", "node", "id"), _merge(labels, third))


def _named_nodes(named: DataFrame) -> DataFrame:
    """(digest, node, id, raw, bands): a node per set, named by the least id that holds it.

    Where that id holds other sets too, which ids that repeat with other texts bring about, all but one of its sets are
    named by a negative hash instead.
    """
    key = F.xxhash64("digest")
    repeated = materialize(
        named.groupBy("id").agg(F.min(key).alias("own"), F.max(key).alias("other")).where("own <> other").select("id", "own"), "repeated"
    )
    owners = named.groupBy("digest").agg(F.min(F.struct("id", "raw")).alias("at"), F.first("bands").alias("bands")).select(
        "digest", "at.*", "bands"
    )
    extra = F.xxhash64("id", "digest").bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    node = F.when(F.col("own").isNull() | (F.col("own") == key), F.col("id")).otherwise(extra)
    return owners.join(repeated, "id", "left").select("digest", node.alias("node"), "id", "raw", "bands")


def _ordered(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("pivot", "node").alias("u"), F.greatest("pivot", "node").alias("v")).distinct()


def _rest(buckets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that may link.

    One of the two is outside the bucket's least component, so only such members are met with the others.
    """
    rows = buckets.join(placed.select("node", "label"), "node")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    rows = buckets.join(placed, "node").join(mixed.select("bucket", "least"), "bucket")
    u = _side(rows.where("label <> least"), "u_")
    v = _side(rows, "v_")
    other = (F.col("v_label") == F.col("v_least")) | (F.col("u_node") < F.col("v_node"))
    met = u.join(
        v,
        (F.col("u_bucket") == F.col("v_bucket")) & (F.col("u_label") != F.col("v_label")) & other & _may_link(percent),
    )
    return met.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def _result(sketches: DataFrame, owners: DataFrame, labels: DataFrame) -> DataFrame:
    placed = owners.join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    of_set = placed.select("digest", "label").join(least, "label").select("digest", "component_id")
    joined = sketches.where("id is not null").join(of_set, "digest", "left").select(
        "id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "raw"
    )
    unnamed = sketches.where("id is null").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), "raw")
    return joined.unionByName(unnamed).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group; rows without an id stay.

    Rows are named by id and a hash of their text, as an id may repeat with other texts.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    named = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("raw"),
    )
    gone = near_classes(docs, id_col, text_col, words, percent).where("not kept").select("id", "raw").distinct()
    return named.join(gone, ["id", "raw"], "left_anti").select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_classes(docs, words=3, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept"
    )
