"""Benchmark decontamination by spaced seeds.

A seed hashes the tokens that a fixed mask selects from a window and ignores the others, so a replaced token at an ignored
position does no harm. The masks of an item length are a lossless family (:func:`masks_of`): whatever tokens are
replaced, an overlap that counts holds a window in which one of them selects equal tokens only. Items and documents
are hashed alike and joined on the seed. Documents first pass a bitmap of the items' seeds: it has a fixed size whatever
the benchmark's, and only thins the rows out, as the join that follows is exact. Around every hit, document and item are
laid on each other at the hit's offset and the run with the most equal tokens is taken, of all that agree in four of
five tokens or more.

A document is contaminated by an item if a run holds ``min(overlap, 0.8 * item tokens)`` equal tokens, rounded up: all of an
item under five tokens. Tokens are words with A-Z in lower case and trailing ASCII punctuation left out; an item without
tokens matches nothing.

Defined cases: null text has no tokens; a null id is reported as null; equal texts are verified once and all reported;
repeated rows are reported once each; empty documents or an empty benchmark give no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.llm import textkit
from bucketwise.llm.textkit import byte_rows, mix, only, pieces, seeds, table
from bucketwise.sources.scratch import materialize

OVERLAP = 13
#: masks per item length, and the most tokens that one selects
FAMILY, HEAVIEST = 4, 6
#: bits of the bitmap that thins out document seeds; its size is the broadcast's proven bound (4 MiB)
BITMAP_BITS = 25
#: alignments verified with one copy of a text
ALIGNMENTS = 256

_U = np.uint64
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textkit.word_hashes(*byte_rows(column), codes=_TOKEN_CODES)


_TOKEN_CODES = textkit.byte_codes(fold=True, ignored=_PUNCTUATION)


def needed(n: int, overlap: int = OVERLAP) -> int:
    """Equal tokens that an item of ``n`` tokens has to share."""
    return min(overlap, -(-4 * n // 5))


@lru_cache(maxsize=64)
def runs(least: int, longest: int) -> tuple[tuple[int, np.ndarray], ...]:
    """(tokens, bit sets of the other tokens) of all runs that count and of which no part counts by itself.

    A run has ``e >= least`` equal tokens, one at either end, and at most ``e // 4`` others. One with ``2 * least`` equal
    tokens or more falls into two parts, one of which counts as well.
    """
    out = []
    for e in range(least, min(2 * least - 1, longest) + 1):
        for other in range(min(e // 4, longest - e) + 1):
            n = e + other
            sets = [sum(1 << p for p in c) for c in combinations(range(1, n - 1), other)]
            out.append((n, np.array(sets, dtype=np.int64)))
    return tuple(out)


def missed(n: int, sets: np.ndarray, mask: str) -> np.ndarray:
    """The runs of ``n`` tokens in which the mask selects another token wherever it is laid."""
    picks = int(mask[::-1], 2)
    for shift in range(n - len(mask) + 1):
        sets = sets[(sets & (picks << shift)) != 0]
    return sets


def _spaced(weight: int, longest: int) -> list[str]:
    """Masks that select ``weight`` tokens, both ends among them, and ignore one to four between."""
    spans = range(weight + 1, min(weight + 4, longest) + 1)
    chosen = ((n, {0, n - 1, *c}) for n in spans for c in combinations(range(1, n - 1), weight - 2))
    return ["".join("1" if i in c else "0" for i in range(n)) for n, c in chosen]


@lru_cache(maxsize=64)
def _family(least: int, longest: int) -> tuple[str, ...]:
    """The heaviest spaced masks, ``FAMILY`` at most, that together miss no run that counts."""
    for weight in range(min(least - 1, HEAVIEST), 1, -1):
        left, masks = dict(enumerate(runs(least, longest))), []
        candidates = _spaced(weight, longest)
        while left and candidates and len(masks) < FAMILY:
            shown = [(n, sets[:: len(sets) // 2000 + 1]) for n, sets in left.values()]
            masks.append(min(candidates, key=lambda m: (sum(len(missed(n, sets, m)) for n, sets in shown), m)))
            left = {k: (n, rest) for k, (n, sets) in left.items() if len(rest := missed(n, sets, masks[-1]))}
        if masks and not left:
            return tuple(sorted(masks))
    return ("1" * max(1, least),)  # items of one or two tokens leave nothing to ignore


def masks_of(n: int, overlap: int = OVERLAP) -> tuple[str, ...]:
    """Fixed masks of the items of ``n`` tokens: whatever tokens are replaced, one selects equal tokens only in every run
    that counts. Each ignores a position at least, and they select as many as a small lossless family can."""
    least = min(needed(n, overlap), OVERLAP)
    return _family(least, n if least < min(overlap, OVERLAP) else 2 * least + least // 2)


def windows(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, position in the row) of every window of the mask that lies inside a row."""
    span, n = len(mask), len(words)
    if n < span:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = seeds(span, int(mask, 2) + 7919 * span)
    total = np.zeros(n - span + 1, _U)
    for j in range(span):
        if mask[j] == "1":
            total += words[j : n - span + 1 + j] * factor[j]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(row[: len(total)] == row[span - 1 :])
    owner = row[inside]
    return mix(total[inside]), owner, inside - bounds[owner]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words, bounds = tokens(batch.column("text"))
        lists = pa.array([words[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("item"), lists], names=["item", "tokens"])


def _seed_rows(masks: dict[int, tuple[str, ...]], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seed, item, at) of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, item, at = [], [], []
            for id_, own in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                words = np.array(own, dtype=np.int64).view(_U)
                for mask in masks.get(min(len(words), top), ()):
                    s, _, p = windows(words, np.array([0, len(words)]), mask)
                    seed.extend(s.view(np.int64).tolist())
                    at.extend(p.tolist())
                    item.extend([id_] * len(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed, pa.int64()), pa.array(item, pa.int64()), pa.array(at, pa.int64())], names=["seed", "item", "at"]
            )
    return run


def _bitmap(seed_rows: DataFrame) -> np.ndarray:
    """Bit ``seed mod 2**BITMAP_BITS`` of every seed, as longs; at most ``2**(BITMAP_BITS - 6)`` rows reach the driver."""
    slot = F.pmod(F.col("seed"), F.lit(1 << BITMAP_BITS))
    words = (
        seed_rows.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(seed, {1 << BITMAP_BITS}) & 63))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), _U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return out


def _hits(bitmap, masks: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in pieces(batches, "text"):
            words, bounds = tokens(batch.column("text"))
            for mask in masks:
                seed, row, at = windows(words, bounds, mask)
                slot = seed & _U((1 << BITMAP_BITS) - 1)
                hit = np.flatnonzero((bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1))
                if len(hit):
                    own = batch.select(["raw", "size"]).take(pa.array(row[hit]))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(seed[hit].view(np.int64)), pa.array(at[hit])],
                        names=["raw", "size", "seed", "pos"],
                    )
    return run


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, first, end) of the run with the greatest sum of 1 per equal and -4 per other token."""
    gain = np.where(equal, 1, -4)
    total = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    first = int(np.flatnonzero(total[: end + 1] == low[end])[-1]) if end else 0
    return int(equal[first:end].sum()), first, end


def most_equal(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, first, end) of the run with the most equal tokens among those that agree in four of five or more.

    From each place the furthest end counts at which the sum of 1 per equal and -4 per other token is not below zero. Ties
    go to the first, and the run begins and ends with an equal token.
    """
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    count = np.concatenate([[0], np.cumsum(equal)])
    ahead = np.maximum.accumulate(total[::-1])  # the greatest sum from a place on, from the last place back
    end = len(equal) - np.searchsorted(ahead, total)
    first = int(np.argmax(count[end] - count))
    held = first + np.flatnonzero(equal[first : end[first]])
    return (len(held), int(held[0]), int(held[-1]) + 1) if len(held) else (0, 0, 0)


def _verified(overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, bounds = tokens(batch.column("text"))
            row, item, equal_n, item_n, start = [], [], [], [], []
            for i, alignments in enumerate(batch.column("alignments").to_pylist()):
                own = words[bounds[i] : bounds[i + 1]].view(np.int64)
                for x in alignments:
                    wanted, offset = np.array(x["tokens"], dtype=np.int64), x["offset"]
                    a, b = max(0, -offset), min(len(wanted), len(own) - offset)
                    if b <= a:
                        continue
                    n, first, _ = most_equal(own[a + offset : b + offset] == wanted[a:b])
                    if n >= needed(len(wanted), overlap):
                        row.append(i)
                        item.append(x["item"])
                        equal_n.append(n)
                        item_n.append(len(wanted))
                        start.append(a + offset + first)
            own = batch.select(["raw", "size"]).take(pa.array(row, pa.int64()))
            rest = [pa.array(v, pa.int64()) for v in (item, equal_n, item_n, start)]
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *rest], names=["raw", "size", "item", "overlap_tokens", "item_tokens", "start_token"]
            )
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = only(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("raw", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", overlap: int = OVERLAP,
) -> DataFrame:
    """Contaminated documents: id, raw, size, item, overlap_tokens, item_tokens, start_token, a row per pair."""
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col)
    wanted = materialize(
        only(items, item=item_id, text=item_text).select(F.col("item").cast("long"), "text")
        .mapInArrow(_item_rows, "item long, tokens array<long>"), "items",
    )
    # from this length on items need as many equal tokens, and have the same masks
    top = -(-5 * overlap // 4)
    lengths = wanted.where("size(tokens) > 0").select(F.least(F.size("tokens"), F.lit(top)).alias("n")).distinct().collect()
    by_length = {r["n"]: masks_of(r["n"], overlap) for r in lengths}
    seed_rows = materialize(wanted.mapInArrow(_seed_rows(by_length, top), "seed long, item long, at long"), "seeds")
    masks = tuple(sorted({m for own in by_length.values() for m in own}))
    bitmap = spark.sparkContext.broadcast(_bitmap(seed_rows))
    found = rows.select("raw", "size", "text").mapInArrow(_hits(bitmap, masks), "raw long, size long, seed long, pos long")
    aligned = materialize(
        found.join(seed_rows, "seed").select("raw", "size", "item", (F.col("pos") - F.col("at")).alias("offset")).distinct(),
        "aligned",
    )
    shares = aligned.groupBy("raw", "size").agg(F.ceil(F.count("*") / ALIGNMENTS).cast("int").alias("shares"))
    lists = (
        aligned.join(shares, ["raw", "size"]).join(wanted, "item")
        .withColumn("share", F.pmod(F.xxhash64("item", "offset"), F.col("shares")))
        .groupBy("raw", "size", "share").agg(F.collect_list(F.struct("item", "offset", "tokens")).alias("alignments"))
    )
    # one row per text: the verdict on a text holds for all its copies
    holders = rows.join(aligned.select("raw", "size").distinct(), ["raw", "size"], "left_semi")
    one = holders.groupBy("raw", "size").agg(F.min("text").alias("text"))
    verdicts = materialize(
        one.join(lists, ["raw", "size"]).select("raw", "size", "text", "alignments").mapInArrow(
            _verified(overlap),
            "raw long, size long, item long, overlap_tokens long, item_tokens long, start_token long",
        )
        .groupBy("raw", "size", "item")
        .agg(F.max("overlap_tokens").alias("overlap_tokens"), F.max("item_tokens").alias("item_tokens"),
             F.min("start_token").alias("start_token")),
        "verdicts",
    )
    return rows.select("id", "raw", "size").join(verdicts, ["raw", "size"])


def drop_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", overlap: int = OVERLAP,
) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    bad = leaks(docs, items, id_col, text_col, item_id, item_text, overlap).select("raw", "size").distinct()
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    wrapped = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(text).alias("raw"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return wrapped.join(bad, ["raw", "size"], "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold; clean documents have no row."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "overlap_tokens", "item_tokens", "start_token"
    )
