"""Array kernels over Arrow text columns, and the few DataFrame helpers the operators share.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these bytes never occur inside a longer UTF-8
sequence, so words of the bytes are words of the text. Kernels take whole texts; memory stays bounded because a
batch is cut into pieces of about a mebibyte and a longer text is hashed in segments cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

PIECE_BYTES = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"
#: the same characters as a class of a regular expression, for JVM functions
WHITE_CLASS = "[ \\t\\n\\x0B\\f\\r]"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits (splitmix)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, start: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(start))


def byte_codes(fold: bool, ignored: bytes = b"") -> np.ndarray:
    """One random word per byte value, zero for white space and bytes to ignore; with ``fold`` A-Z count as a-z."""
    codes = seeds(256, 77)
    codes[_SPACE] = 0
    codes[list(ignored)] = 0
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_FOLDED = byte_codes(fold=True)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            have = len(_POWERS[k])
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * _U(pow(base, have, 1 << 64))])
    return _POWERS[0], _POWERS[1]


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``limit`` bytes of text; one longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def word_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[flat]
    if not len(flat):
        return np.zeros(0, np.int64)
    prior = np.empty_like(inside)
    prior[0] = False
    prior[1:] = inside[:-1]
    prior[offsets[:-1][offsets[:-1] < len(flat)]] = False
    return np.flatnonzero(inside & ~prior)


def _segments(flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``starts`` whose bytes span about a piece."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE_BYTES, side="left")))
        yield first, last
        first = last


def word_hashes(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray = _FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row and in all).

    A word's hash is a polynomial in its bytes, taken at the word's own start, then mixed.
    """
    starts = word_starts(flat, offsets)
    out = np.empty(len(starts), _U)
    for first, last in _segments(flat, starts):
        a = starts[first]
        b = starts[last] if last < len(starts) else len(flat)
        power, inverse = _powers(int(b - a) + 1)
        terms = codes[flat[a:b]] * power[: b - a]
        at = starts[first:last] - a
        out[first:last] = np.add.reduceat(terms, at) * inverse[at]
    return mix(out), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``k`` words, bounds by row); a row of 1 to k-1 words has one run, the whole of it."""
    counts = np.diff(bounds)
    factor = seeds(k, 911)
    n = len(words)
    full = np.zeros(max(n - k + 1, 0), _U)
    for j in range(k):
        full += words[j : n - k + 1 + j] * factor[j] if n >= k else full
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: len(full)] == row[k - 1 :] if n >= k else np.zeros(0, bool)
    whole, owner = mix(full[inside]), row[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for i, r in enumerate(short):
            w = words[bounds[r] : bounds[r + 1]]
            extra[i] = (w * factor[: len(w)]).sum() + _U(len(w))
        whole = np.concatenate([whole, mix(extra)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        whole, owner = whole[order], owner[order]
    return whole, np.searchsorted(owner, np.arange(len(counts) + 1))


def sets_of(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each row."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns under internal names, whatever else the table holds."""
    return df.select(*[(df[f"`{c}`"] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
