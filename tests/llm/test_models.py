from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import mixing, quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    step = rng.normal(size=(2, 2))
    evidence, lengths = rng.normal(size=(3, 5)), np.array([5, 3, 1])
    good, counts = quality.forward_backward(evidence, lengths, step)
    total = np.zeros((2, 2))
    for c, n in enumerate(lengths):
        weights = {}
        for labels in product((0, 1), repeat=int(n)):
            score = sum(evidence[c, i] for i in range(n) if labels[i]) + sum(step[labels[i], labels[i + 1]] for i in range(n - 1))
            weights[labels] = np.exp(score)
        z = sum(weights.values())
        for i in range(n):
            assert good[c, i] == pytest.approx(sum(w for k, w in weights.items() if k[i]) / z, abs=1e-6)
        for k, w in weights.items():
            for i in range(n - 1):
                total[k[i], k[i + 1]] += w / z
    assert counts == pytest.approx(total, abs=1e-6)


def prose(rng, bad):
    lines = []
    for _ in range(rng.randrange(1, 8)):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 30))]
        lines.append(" ".join(w + "$$$" for w in words) if bad else " ".join(words).capitalize() + ".")
    return "\n".join(lines)


def test_quality_learns_and_handles_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, i % 2 == 0), "en", 0.5) for i in range(400)]
    odd = [(1000, None, None, None), (1001, "", "en", 0.1), (None, "Some words here.", "en", 0.2), (1002, "x$$$ " * 200_000, "en", 0.1), (1003, "\n" * 5000, "en", 0.0)]
    docs = spark.createDataFrame(rows + odd + rows[:1], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5000, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by = {r["id"]: r for r in got}
    for i in range(400):
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["id"] is not None and r["id"] < 400]
    assert np.mean([r["predicted"] == r["id"] % 2 for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert by[1000]["score"] == by[1001]["score"] and by[1002]["predicted"] == 0 and not by[None]["held_out"]
    kept = quality.drop_poor(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def fill(sizes, weights):
    """Shares by weight, capped at three times the size, the excess reshared until none is above."""
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    rest = float(total)
    while left:
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] > 3 * sizes[i]}
        if not over:
            for i in left:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            rest -= target[i]
        left -= over
    return target


def test_targets(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 23):
        sizes = [rng.choice((0, 1, 10, 500, 10_000)) for _ in range(n)]
        names = sorted(f"s{rng.randrange(10**6)}" for _ in range(n - 1)) + [None]
        frame = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)])
        assert [got[x] for x in names] == pytest.approx(want)


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice((1, 5, 40, 300))), rng.choice(("a", "b", "b", "b", "c", None)), i) for i in range(900)]
    rows += [(2000, None, "a", 0), (2001, "", "d", 0), (2002, " \n", "e", 0), (None, "x y z", "a", 0)] + [(3000, "q " * 7, "b", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(5)
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    for name in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 300
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        times = own[0]["target"] / own[0]["source_size"]
        assert all(r["copies"] in (int(times), int(times) + 1) for r in own if r["size"])
    assert [r["taken"] for r in got if r["id"] in (2000, 2001, 2002)] == [0, 0, 0]
    key = lambda rs: sorted((r["id"] or -1, r["source"] or "", r["taken"]) for r in rs)
    assert key(mixing.mix_sizes(docs.repartition(11)).collect()) == key(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("a", "b", "c", None)}
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 == mixing.mix(docs.limit(0)).count()


def test_rounding_keeps_expected_copies(spark):
    rows = [(i, "w " * (1 + i % 7), s, 0) for i in range(60) for s in ("a", "b")]
    docs = spark.createDataFrame([(2 * i + (s == "b"), t, s, z) for i, t, s, z in rows], "doc_id long, text string, source string, z int")
    runs = [mixing.mix_sizes(docs, seed=100 * k).collect() for k in range(8)]
    times = runs[0][0]["target"] / runs[0][0]["source_size"]
    first = runs[0][0]["source"]
    mean = np.mean([r["copies"] for run in runs for r in run if r["source"] == first])
    assert abs(mean - times) < 0.1
