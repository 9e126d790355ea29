"""Byte-level BPE, exact and in linear time: a backtracking encoder over longest matches, and a decoder by offsets.

Encoding. A text is split at the vocabulary's added tokens, then into pre-tokens by its pattern. One Aho-Corasick pass
over a pre-token gives the longest token that starts at every byte. The encoder goes from left to right, takes the
longest token that is *compatible* with the one before it, else the longest shorter one, else it takes the last token
back and marks the place as dead. Two tokens are compatible when merging their bytes by rank keeps the border between
them: :meth:`Tables.fits` undoes their merges from the last to the first, looking in the pair table for an earlier merge
across the border. A chain of compatible tokens is what merging by rank gives, and every byte position is opened and
closed once. Pre-tokens repeat, so each Python worker keeps the codes of at most ``REMEMBERED`` short ones.

Decoding. The bytes of all tokens lie in one block; an offset table says where each begins. A column of ids becomes one
gather over that block.

The vocabulary is read once on the driver and broadcast; its size is that of the file (50,000 tokens: about 2 MB).

Defined cases: null text is empty and has no ids; null ids decode to an empty text; null or unknown ids in a list are
skipped; bytes that aren't UTF-8 become U+FFFD as in the tokenizers library; any id type, repeated and null ids are
kept as rows; an empty table gives an empty one; other columns take no part. A long text is taken in segments cut
before white space; a run without white space is one pre-token, at nine bytes of memory a byte.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import only, pieces, table

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 1 << 19
SHORT = 48
SEGMENT = 1 << 16

# Code points that Unicode 16 added to the letters and to the numbers of Unicode 15.1
LATE_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b "
    "1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c "
    "18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
)
LATE_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"


def _members(kind: str, late: str) -> np.ndarray:
    """Which code points are of a general category in Unicode 16."""
    inside = np.array([unicodedata.category(chr(i))[0] == kind for i in range(sys.maxunicode + 1)])
    for span in late.split():
        a, b = (int(x, 16) for x in span.split("-"))
        inside[a : b + 1] = True
    return inside


def _ranges(inside: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _pattern(letter: str, number: str, space: str) -> str:
    """Contractions, then letters, numbers or other marks with a space before them, then white space."""
    return rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


@lru_cache(maxsize=1)
def splitters() -> tuple[regex.Pattern, re.Pattern, re.Pattern]:
    """(pattern for any text, the same for texts of the basic plane, code points outside of that).

    Both spell out Unicode 16. Classes of the basic plane are bitmaps in ``re``, several times as quick as in ``regex``.
    """
    letter, number = _members("L", LATE_LETTERS), _members("N", LATE_NUMBERS)
    space = np.zeros(sys.maxunicode + 1, dtype=bool)
    for run in regex.finditer(r"\s+", "".join(map(chr, range(sys.maxunicode + 1)))):
        space[run.start() : run.end()] = True
    return (
        regex.compile(_pattern(*map(_ranges, (letter, number, space)))),
        re.compile(_pattern(*(_ranges(inside[:0x10000]) for inside in (letter, number, space)))),
        re.compile("[\U00010000-\U0010ffff]"),
    )


#: any pre-token ends before white space that follows something else
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n]")


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT:
        hit = _CUT.search(text, at + SEGMENT)
        if hit is None:
            break
        yield text[at : hit.start()]
        at = hit.start()
    yield text[at:]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs. Tokens are numbered by merge rank: 256 bytes, then one per merge."""

    tokens: tuple[bytes, ...]  # by number
    left: tuple[int, ...]  # what a merge joins; a byte has itself
    right: tuple[int, ...]
    ids: tuple[int, ...]  # the file's id of each number
    added: tuple[tuple[str, int], ...]  # text and id of tokens that are never merged


def read_vocabulary(path: str) -> Vocabulary:
    """A vocabulary from a tokenizer file with byte-level BPE; other kinds raise ValueError."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (
        model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space")
        or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout")
    ):
        raise ValueError(f"{path}: only plain byte-level BPE is supported")
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added):
        raise ValueError(f"{path}: added tokens must be plain strings")
    letters = _byte_letters()
    byte_names = sorted(letters, key=letters.get)
    names, left, right = list(byte_names), list(range(256)), list(range(256))
    number = {name: i for i, name in enumerate(names)}
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if a + b in number:
            raise ValueError(f"{path}: two merges give {a + b!r}")
        left.append(number[a])
        right.append(number[b])
        number[a + b] = len(names)
        names.append(a + b)
    return Vocabulary(
        tuple(bytes(letters[c] for c in name) for name in names), tuple(left), tuple(right),
        tuple(model["vocab"][name] for name in names), tuple((t["content"], t["id"]) for t in added),
    )


class Tables:
    """A vocabulary's automaton, pair table and offset table, built once per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.left, self.right, self.ids, self.added = v.left, v.right, v.ids, dict(v.added)
        self.size = [len(t) for t in v.tokens]
        self.pairs = {(a, b): i for i, (a, b) in enumerate(zip(v.left, v.right, strict=True)) if i >= 256}
        # a token that its own bytes would not be merged into never occurs
        usable = [i < 256 or self.fits(v.left[i], v.right[i], i) for i in range(len(v.tokens))]
        self.number = {t: i for i, t in enumerate(v.tokens) if usable[i]}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        # the longest usable token that begins another one
        self.shorter = [
            next((self.number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.number), -1) for t in v.tokens
        ]
        by_id = {i: t for i, t in zip(v.ids, v.tokens, strict=True)} | {i: s.encode() for s, i in v.added}
        top = max(by_id, default=-1) + 1
        self.offsets = np.cumsum([0, *(len(by_id.get(i, b"")) for i in range(top))])
        self.block = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        names = sorted(self.added, key=len, reverse=True)
        self.breaks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known, self.borders = _Known(self), _Borders(self)

    def fits(self, a: int, b: int, limit: int = sys.maxsize) -> bool:
        """Whether merging by rank leaves the border between ``a`` and ``b``; merges from ``limit`` on don't count.

        The later of the two merges is undone first, so that what lies at the border goes back in time; a merge across
        the border counts if it is earlier than the last merge undone on either side.
        """
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            across = pairs.get((a, b))
            if across is not None and across < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # of equal ranks the left one was merged first, so the right one is undone first
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def encode_bytes(self, data: bytes) -> array:
        """Token numbers of one pre-token."""
        whole = self.number.get(data)
        if whole is not None:
            return array("i", (whole,))
        n, size, shorter, borders = len(data), self.size, self.shorter, self.borders
        longest = array("i", bytes(4 * n))
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # longer matches end later
        out, alive, at, token = array("i"), bytearray(b"\1") * (n + 1), 0, longest[0] if n else 0
        while at < n:
            end = at + size[token]
            if alive[end] and (not out or borders[out[-1], token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else 0
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        (exact, quick, beyond), known, out = splitters(), self.known, []
        for i, part in enumerate(self.breaks.split(text) if self.breaks else [text]):
            if i % 2:
                out.append(np.int32(self.added[part]).tobytes())
            elif part:
                for segment in _segments(part):
                    split = exact if beyond.search(segment) else quick
                    out.append(b"".join(map(known.__getitem__, split.findall(segment))))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray, bounds: np.ndarray, skip: Iterable[int] = ()) -> list[str]:
        """Texts of the lists of ids between ``bounds``."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        if skip:
            known &= ~np.isin(ids, list(skip))
        ids = np.where(known, ids, 0)
        first = self.offsets[ids]
        size = np.where(known, self.offsets[ids + 1] - first, 0)
        ends = np.cumsum(np.concatenate([[0], size]))
        at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
        flat, cut = self.block[at].tobytes(), ends[bounds]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


class _Borders(dict):
    """Whether pairs of tokens fit, by pair; forgets all when full."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        fits = self[pair] = self.tables.fits(*pair)
        return fits


class _Known(dict):
    """Packed ids by pre-token; forgets all when full."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables, self.packed = tables, [np.int32(i).tobytes() for i in tables.ids]

    def __missing__(self, piece: str) -> bytes:
        packed = b"".join([self.packed[i] for i in self.tables.encode_bytes(piece.encode("utf-8", "replace"))])
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


_BUILT: dict[Vocabulary, Tables] = {}


def tables_of(shared) -> Tables:
    """Tables of a broadcast vocabulary, built at its first use in this process."""
    vocabulary = shared.value
    if vocabulary not in _BUILT:
        _BUILT.clear()
        _BUILT[vocabulary] = Tables(vocabulary)
    return _BUILT[vocabulary]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) for every row."""
    rows = only(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in pieces(batches, "text"):
            tables = tables or tables_of(shared)
            found = [tables.encode(t) if t else np.zeros(0, np.int32) for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(bounds, np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(
    encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids", skip_added: bool = False
) -> DataFrame:
    """id, ids and their text for every row."""
    rows = only(encoded, id=id_col, ids=F.col(f"`{ids_col}`").cast("array<int>"))
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or tables_of(shared)
            skip = set(tables.added.values()) if skip_added else ()
            for first, last in _runs(batch.column("ids")):
                part = batch.slice(first, last - first)
                ids = part.column("ids")
                bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                texts = pa.array(tables.decode(flat, bounds.astype(np.int64), skip), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, texts], names=["id", "ids", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def _runs(lists: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` ids; a longer list is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(lists):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last


def op12_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded again. ``path``: the tokenizer file, else that of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    vocabulary = read_vocabulary(str(path))
    both = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
