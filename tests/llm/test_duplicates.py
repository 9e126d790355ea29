from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import components, exact_dedup, line_dedup, near_dedup, textkit

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def frame(spark, rows, schema="doc_id long, text string, id string, fp int"):
    return spark.createDataFrame(rows, schema)


def test_fingerprint_composes():
    data = bytes(range(256)) * 1000
    whole = exact_dedup.fingerprint(data)
    direct = tuple(
        sum((c + 1) * pow(exact_dedup.BASES[k], len(data) - 1 - i, exact_dedup.PRIMES[k]) for i, c in enumerate(data))
        % exact_dedup.PRIMES[k] for k in range(2)
    )
    assert whole == direct[0] << 31 | direct[1]
    assert exact_dedup.fingerprint(b"") == 0


def test_chunk_rows_combine_to_the_whole(spark):
    data, size = bytes(random.Random(5).randrange(256) for _ in range(5000)), 700
    rows = []
    for at in range(0, len(data), size):
        chunk = data[at : at + size]
        rows.append((1, len(chunk), len(data) - at - len(chunk), *exact_dedup.chunk_hash(chunk)))
    chunks = spark.createDataFrame(rows, "doc long, size long, behind long, a long, b long").repartition(3)
    got = exact_dedup.combine_chunks(chunks, "doc", "size", "behind", "a", "b").first()
    assert (got["size"], got["fp"]) == (len(data), exact_dedup.fingerprint(data))


def test_exact_classes_edge_cases(spark):
    long = "x" * 200_000
    rows = [
        (5, "a b", "p", 1), (3, "ab", "q", 2), (9, " a\tb ", None, None), (4, None, "", 0), (2, "", "", 0), (8, " \n", "", 0),
        (7, "solo", "s", 1), (7, "solo", "s", 1), (None, "ab", "n", 1), (None, "lone", "n", 1), (11, long, "", 0),
        (12, long + " ", "", 0), (13, long[:-1] + "y", "", 0),
    ]
    got = exact_dedup.exact_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert {(r["keep_id"], r["group_size"]) for i in (5, 3, 9) for r in by[i]} == {(9, 4)}
    assert [r["kept"] for i in (5, 3, 9) for r in by[i]] == [False, False, True]
    assert {(r["keep_id"], r["group_size"]) for i in (4, 2, 8) for r in by[i]} == {(8, 3)}
    assert sorted(r["kept"] for r in by[7]) == [False, True] and by[7][0]["group_size"] == 2
    assert by[11][0]["keep_id"] == 12 and by[13][0]["kept"]
    assert by[3][0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_classes(frame(spark, [])).count() == 0
    stay = exact_dedup.drop_exact(frame(spark, rows))
    assert stay.columns == ["doc_id", "text", "id", "fp"]
    assert sorted(r["doc_id"] for r in stay.where("doc_id is not null").collect()) == [7, 8, 9, 12, 13]


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    prints = spark.createDataFrame(
        [(i, i * 10, 2, "s", 2, 77, 1) for i in (1, 2, 3)], "id long, raw long, chars long, sha string, size long, fp long, copies long"
    )
    rows = spark.createDataFrame([(1, "ab", 10), (2, "ac", 20), (3, "ab", 30)], "id long, text string, raw long")
    assert [r["id"] for r in exact_dedup._differing(rows, prints).collect()] == [2]


def test_components_of_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(1, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    for n, same in ((1, 1), (5, 4), (60, 45), (2000, 1500)):
        pool = textkit.mix(rng.integers(1, 1 << 62, 2 * n).astype(np.uint64))
        a, b = pool[:n], np.concatenate([pool[:same], pool[n : 2 * n - same]])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        assert x.max() < np.iinfo(np.uint64).max
        assert abs((x == y).mean() - same / (2 * n - same)) < 0.2
        assert (near_dedup.sketch(a[::-1]) == x).all()


def brute_components(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((8, 40, 120)))]
        for _ in range(20):  # edits around the threshold, so that chains form
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "one two"), (506, "w " * 3000)]
    for words, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, words, percent)


def test_near_edge_cases(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (2, "A b C d e f", "y", 2)]
    got = near_dedup.near_classes(frame(spark, rows)).collect()
    assert sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)
    ]
    assert near_dedup.near_classes(frame(spark, [])).count() == 0
    assert near_dedup.drop_near(frame(spark, rows)).columns == ["doc_id", "text", "id", "fp"]


def test_ids_that_repeat_with_other_texts_lose_none(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(f"{n}{rng.randrange(900)}" for _ in range(40)) for n in "xyz")
    rows = [(1, one, "", 0), (5, one, "", 0), (5, two, "", 0), (7, three + " end", "", 0), (3, three, "", 0), (7, two + " end", "", 0), (7, "alone a b c d e", "", 0),
            (5, None, "", 0)]
    kept = sorted((r["doc_id"], (r["text"] or "")[:5]) for r in near_dedup.drop_near(frame(spark, rows)).collect())
    assert kept == sorted([(1, one[:5]), (5, two[:5]), (3, three[:5]), (7, "alone"), (5, "")])
    again = near_dedup.drop_near(frame(spark, [(5, one, "", 0), (5, two, "", 0), (6, two + " end", "", 0), (5, three, "", 0), (4, three + " end", "", 0)]))
    assert sorted((r["doc_id"], r["text"][:1], r["text"][-3:] == "end") for r in again.collect()) == [(4, "z", True), (5, "x", False), (5, "y", False)]


def test_shingles_match_words():
    texts = ["a b c", "", None, "A b  C d\te", "é é é é", " ", "one two", "x" * 3_000_000 + " y z"]
    hashes, bounds = textkit.shingle_hashes(*textkit.word_hashes(*textkit.byte_rows(pa.array(texts))), 3)
    sizes = [len(s) for s in textkit.sets_of(hashes, bounds)]
    assert sizes == [1, 0, 0, 3, 1, 0, 1, 1]


def brute_passages(rows):
    """{(id, text): (text, lines removed)}: units of two lines or a long one, the first occurrence by id and place stays."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first, out = {}, {}
    units = {}
    for doc in docs:
        lines = doc[1].split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        own = [(a, b, (lines[a], lines[b])) for a, b in zip(full, full[1:])] + [(a, a, (lines[a],)) for a in full if len(re.findall(r"[^\x20\x09-\x0d]+", lines[a])) > 50]
        units[doc] = sorted(own)
        for a, b, body in units[doc]:
            first.setdefault(body, (doc, a, b))
    for doc in docs:
        gone = set()
        for a, b, body in units[doc]:
            home, c, d = first[body]
            if (home, c) != (doc, a):
                gone.update(range(max(a, d + 1) if home == doc else a, b + 1))
        lines = doc[1].split("\n")
        out[doc] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_planted_passages_are_removed_whole(spark):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**9)}"
    line = lambda n: " ".join(word() for _ in range(n))
    passages = {n: [line(60 // n) for _ in range(n)] for n in range(1, 6)}
    rows, clean = [], {}
    for i in range(40):
        n = i % 5 + 1
        before, after = ([line(rng.randrange(3, 30)) for _ in range(rng.randrange(4))] for _ in range(2))
        rows.append((i, "\n".join(before + passages[n] + after)))
        clean[i] = "\n".join(before + (passages[n] if i < 5 else []) + after)
    got = {r["id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == clean
    assert all(r["n_removed"] == (0 if i < 5 else i % 5 + 1) for i, r in got.items())


@pytest.mark.parametrize("keys", [1 << 62, 3])
def test_passages_equal_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(line_dedup, "line_key", lambda line: F.pmod(F.xxhash64(line), F.lit(keys)))  # few keys: lines collide
    rng = random.Random(18)
    pool = ["a", "b", "c d", " ", "", "x " * 51, " é" * 50, "last\r", "e f g"]
    rows = [(i, "\n".join(rng.choice(pool[: rng.randrange(2, 10)]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(0, rows[0][1]), (None, "a\nb\nq"), (60, None), (61, ""), (62, "a\n" * 20_000), (63, "x\nx\nx\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).collect()
    want = brute_passages(rows)
    texts = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_removed"]) == want[r["id"], texts[r["id"]]], r["id"]
        assert r["n_lines"] == texts[r["id"]].count("\n") + 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_exact_ids_at_the_ends_of_their_range(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(low, "a b"), (high, "ab"), (low + 1, "c"), (0, " c"), (high, None)], "doc_id long, text string")
    got = sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_classes(docs).collect())
    assert got == [(low, low, 2, True), (low + 1, 0, 2, False), (0, 0, 2, True), (high, low, 2, False), (high, high, 1, True)]
