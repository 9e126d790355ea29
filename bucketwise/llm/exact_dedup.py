"""Exact dedup by composable polynomial fingerprints.

A text, with white space deleted, is cut into chunks. Each chunk gets a polynomial hash modulo two primes on its own;
``hash(a + b) = hash(a) * base**len(b) + hash(b)``, so a fingerprint is the sum of the chunk hashes, each shifted by the
bytes behind it. A text that stands in one row is combined where it lies; documents stored as many chunk rows are
combined by :func:`combine_chunks` without bringing their chunks together. Documents of equal fingerprint are then
compared with the first of their group chunk by chunk, in joins whose keys are split by the size of the group; a text
that differs after all forms a group by its digest.

Defined cases: null text counts as empty, and all empty texts are equal. A null id ranks last; rows without an id are
confirmed by digest, as nothing names their text. Rows that repeat id and text count one by one, and one of them stays.
An empty table gives no rows. Other columns take no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bucketwise.llm.textkit import WHITE, byte_rows, only, pieces, table
from bucketwise.sources.scratch import materialize

CHUNK_BYTES = 1 << 16
#: members of a group that one copy of its first text is compared with
GROUP_SHARE = 512
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 7368787)

_U = np.uint64


@cache
def _powers(k: int) -> np.ndarray:
    powers = [1]
    for _ in range(CHUNK_BYTES):
        powers.append(powers[-1] * BASES[k] % PRIMES[k])
    return np.array(powers, dtype=_U)


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Polynomial hashes of at most ``CHUNK_BYTES`` bytes; a byte counts one more than its value."""
    codes = np.frombuffer(chunk, dtype=np.uint8).astype(_U) + _U(1)
    n = len(codes)
    return tuple(int((codes * _powers(k)[:n][::-1]).sum() % _U(PRIMES[k])) for k in range(2))


def shifted(hashes: tuple[int, int], behind: int) -> tuple[int, int]:
    """Chunk hashes moved in front of ``behind`` bytes."""
    return tuple(h * pow(BASES[k], behind, PRIMES[k]) % PRIMES[k] for k, h in enumerate(hashes))


def fingerprint(text: bytes) -> int:
    """Both hashes of a whole text, combined from its chunks, in 62 bits."""
    total = [0, 0]
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        for k, h in enumerate(shifted(chunk_hash(chunk), len(text) - at - len(chunk))):
            total[k] = (total[k] + h) % PRIMES[k]
    return total[0] << 31 | total[1]


def combine_chunks(chunks: DataFrame, id_col: str, size: str, behind: str, first: str, second: str) -> DataFrame:
    """Fingerprints of documents given as chunk rows: chunk hashes, their bytes, and the bytes behind each.

    The shift is a repeated squaring over the bits of ``behind``; sums combine map-side, in any order.
    """
    def power(k: int):
        squares = F.array(*[F.lit(pow(BASES[k], 1 << b, PRIMES[k])).cast("long") for b in range(63)])
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(63)), F.lit(1).cast("long"),
            lambda acc, b: F.when(
                F.col(behind).bitwiseAND(F.element_at(masks, b)) != 0, acc * F.element_at(squares, b) % PRIMES[k]
            ).otherwise(acc),
        )

    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(63)])
    parts = chunks.select(
        F.col(id_col).alias("id"), F.col(size).alias("size"),
        (F.col(first) * power(0) % PRIMES[0]).alias("p0"), (F.col(second) * power(1) % PRIMES[1]).alias("p1"),
    )
    return parts.groupBy("id").agg(
        F.sum("size").alias("size"),
        (F.shiftleft(F.sum("p0") % PRIMES[0], 31) + F.sum("p1") % PRIMES[1]).alias("fp"),
    )


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        flat, offsets = byte_rows(batch.column("text"))
        sha, size, fp = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text = flat[a:b].tobytes().translate(None, WHITE)
            sha.append(hashlib.sha256(text).hexdigest())
            size.append(len(text))
            fp.append(fingerprint(text))
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["id", "raw", "chars"]).columns, pa.array(sha), pa.array(size, pa.int64()), pa.array(fp, pa.int64())],
            names=["id", "raw", "chars", "sha", "size", "fp"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["id", "raw", "fp", "size", "lead", "shares"]
    for batch in pieces(batches, "text"):
        flat, offsets = byte_rows(batch.column("text"))
        row, number, chunk = [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            text = flat[a:b].tobytes().translate(None, WHITE)
            for k, at in enumerate(range(0, len(text), CHUNK_BYTES)):
                row.append(i)
                number.append(k)
                chunk.append(text[at : at + CHUNK_BYTES])
        kept = batch.select(keys).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(number, pa.int32()), pa.array(chunk, pa.binary())], names=[*keys, "number", "chunk"]
        )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (never null) and a hash of the raw text, which tells rows of one id apart."""
    rows = only(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("raw", F.xxhash64("text"))


def _differing(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(id, raw) of texts unlike the first of their fingerprint group."""
    groups = (
        prints.groupBy("fp", "size")
        .agg(F.sum("copies").alias("n"), F.count("*").alias("texts"), F.min("id").alias("first_id"))
        .where((F.col("texts") > 1) & (F.col("size") > 0))
        .select("fp", "size", "first_id", F.ceil(F.col("n") / GROUP_SHARE).cast("int").alias("shares"))
    )
    members = (
        prints.where("id is not null").select("id", "raw", "fp", "size").join(groups, ["fp", "size"])
        .select("id", "raw", "fp", "size", "shares", (F.col("id") == F.col("first_id")).alias("lead"))
    )
    chunks = materialize(
        rows.join(members, ["id", "raw"]).select("id", "raw", "fp", "size", "lead", "shares", "text").mapInArrow(
            _chunks, "id long, raw long, fp long, size long, lead boolean, shares int, number int, chunk binary"
        ),
        "chunks",
    )
    key = ["fp", "size", "number", "share"]
    # the least of the lead's chunks, should one id carry two such texts
    lead = (
        chunks.where("lead").groupBy("fp", "size", "number", "shares").agg(F.min("chunk").alias("lead_chunk"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    )
    return (
        chunks.withColumn("share", F.pmod(F.xxhash64("id", "raw"), F.col("shares").cast("long")).cast("int"))
        .join(lead, key, "left")
        .where(F.coalesce(F.col("chunk") != F.col("lead_chunk"), F.lit(True)))
        .select("id", "raw").distinct().withColumn("differs", F.lit(True))
    )


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, raw, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id stays.
    """
    rows = _rows(docs, id_col, text_col)
    prints = materialize(
        rows.withColumn("chars", F.length("text").cast("long"))
        .mapInArrow(_prints, "id long, raw long, chars long, sha string, size long, fp long")
        .groupBy("id", "raw", "chars", "sha", "size", "fp").agg(F.count("*").alias("copies")),
        "prints",
    )
    lead_sha = prints.groupBy("fp", "size").agg(F.min_by("sha", F.coalesce("id", F.lit((1 << 63) - 1))).alias("lead_sha"))
    named = prints.where("id is not null").join(_differing(rows, prints), ["id", "raw"], "left").select(
        *prints.columns, F.when(F.col("differs"), F.col("sha")).alias("part")
    )
    unnamed = prints.where("id is null").join(lead_sha, ["fp", "size"]).select(
        *[F.col(c) for c in prints.columns], F.when(F.col("sha") != F.col("lead_sha"), F.col("sha")).alias("part")
    )
    members = named.unionByName(unnamed).withColumn("part", F.coalesce("part", F.lit("")))
    # a table of its own, so that the join has two plain exchanges and Spark can split a hot group
    classes = materialize(
        members.groupBy("fp", "size", "part").agg(
            F.sum("copies").alias("group_size"), F.max(F.struct("chars", F.bitwise_not("id").alias("rank"))).alias("best")
        ),
        "classes",
    )
    joined = members.join(classes, ["fp", "size", "part"]).select(
        "id", "raw", "group_size", "sha", "copies", F.bitwise_not("best.rank").alias("keep_id"),
        (F.col("id").eqNullSafe(F.bitwise_not("best.rank")) & (F.col("chars") == F.col("best.chars"))).alias("stays"),
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "id", "raw", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows without an id all stay."""
    kept = exact_classes(docs, id_col, text_col).where("kept and id is not null").select("id", "raw").distinct()
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    wrapped = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"),
        F.xxhash64(text).alias("raw"),
    )
    once = Window.partitionBy("id", "raw").orderBy("id")
    staying = (
        wrapped.where("id is not null").join(kept, ["id", "raw"], "left_semi")
        .withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
    )
    return staying.unionByName(wrapped.where("id is null").select("row.*"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )
