from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from bucketwise.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
files = pytest.importorskip("public_tokenizers")
PATH = files.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def tables(vocabulary):
    return bpe.Tables(vocabulary)


@pytest.fixture(scope="module")
def other():
    return tokenizers.Tokenizer.from_file(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "'s", "'ll", " ", "  ", "\n", "don't", "ABC", "\x1c", "\x85", "　", "12", "!!", "\U0001f600", "Ᲊ", "꟔"]
    for k in range(n):
        yield (
            "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(rng.randrange(40))),
            "".join(rng.choice("ab ' \n\ts<|endoftext|>0é") for _ in range(rng.randrange(200))),
            rng.choice(["a", "ab", "aa b", "\n ", "=", "-=", "了"]) * rng.randrange(300),
            "".join(rng.choice(parts) for _ in range(rng.randrange(30))),
            "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(100))),
        )[k % 5]


@pytest.mark.parametrize("segment", [bpe.SEGMENT, 7])
def test_ids_equal_the_library(tables, other, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    for text in texts(3000, segment):
        want = other.encode(text, add_special_tokens=False).ids
        assert tables.encode(text).tolist() == want
        random.Random(1).shuffle(want)
        assert tables.decode(np.array(want, np.int64), np.array([0, len(want)])) == [other.decode(want, skip_special_tokens=False)]


def merged(v, data):
    """Plain BPE: the earliest merge first, leftmost of equals."""
    pairs = {(a, b): i for i, (a, b) in enumerate(zip(v.left, v.right)) if i >= 256}
    number = {t: i for i, t in enumerate(v.tokens[:256])}
    out = [number[bytes([b])] for b in data]
    while True:
        best = min(((pairs[p], i) for i, p in enumerate(zip(out, out[1:])) if p in pairs), default=None)
        if best is None:
            return out
        out[best[1] : best[1] + 2] = [best[0]]


def test_backtracking_equals_merging_by_rank(vocabulary, tables):
    rng = random.Random(4)
    for _ in range(400):
        data = bytes(rng.choice(b"aehinorst lt") for _ in range(rng.randrange(1, 60)))
        assert list(tables.encode_bytes(data)) == merged(vocabulary, data)


def test_small_caches_change_nothing(tables, monkeypatch):
    rows = list(texts(200, 9))
    before = [tables.encode(t).tolist() for t in rows]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [tables.encode(t).tolist() for t in rows] == before


def test_rows_and_round_trip(spark, vocabulary, other):
    rows = [(None, "null id", 1), (1, None, 2), (2, "", 3), (3, "a b" * 400_000, 4), (3, "x" * 300_000, 4), (4, "café <|endoftext|>!", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in out) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert all(r["ids"] == other.encode(r["text"], add_special_tokens=False).ids for r in out)
    ids = spark.createDataFrame([("a", [15496, None, 99999, -1, 50256]), ("b", None), ("c", [])], "id string, ids array<int>")
    texts = {r["id"]: r["text"] for r in bpe.decode(ids, vocabulary).collect()}
    assert texts == {"a": "Hello<|endoftext|>", "b": "", "c": ""}
    assert {r["text"] for r in bpe.decode(ids, vocabulary, skip_added=True).collect()} == {"Hello", ""}
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.read_vocabulary(files.path("word_bpe_49k.json"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables absent")
def test_query_equals_the_library(spark, other):
    got = {r["doc_id"]: r for r in bpe.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = other.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = other.decode(ids, skip_special_tokens=False)
        assert mine["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_texts_of_the_basic_plane_are_split_by_the_quicker_engine():
    import random
    import re

    from bucketwise.llm import bpe

    exact, quick, beyond = bpe.splitters()
    assert isinstance(quick, re.Pattern) and beyond.search("\U0001f600") and not beyond.search("￿")
    plane = "".join(map(chr, range(0x10000)))
    draw = random.Random(5)
    texts = [plane, *("".join(draw.choices("'sdl vére  \t\n\x1c\x85\xa0 　aZß9²Ⅷ中́Ɤ-.", k=60)) for _ in range(3000))]
    assert all(exact.findall(t) == quick.findall(t) for t in texts)
