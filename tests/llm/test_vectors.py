from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import hard_negatives as hn, whitening as wh

VECTORS = "vec_id long, label int, embedding array<bigint>, anchor string, tag int, slice int, key string"


def brute(rows, is_anchor, positives=5, negatives=5):
    """Rows are (id, label, vector); equal (score, id) pairs count once."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    out = set()
    for a in {(i, lab, tuple(v)) for i, lab, v in rows if is_anchor(i)}:
        scored = {(-sum(x * y for x, y in zip(a[2], v)), i, lab == a[1]) for i, lab, v in rows if i != a[0] or lab != a[1]}
        best = sorted(s[:2] for s in scored if s[2] and s[1] != a[0])[:positives]
        for p, pid in best:
            hard = sorted(s[:2] for s in scored if not s[2] and -80 * p <= -100 * s[0] <= -100 * p)[:negatives]
            out |= {(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(hard)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], VECTORS)


def mined(df, **options):
    return [tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0, **options).collect()]


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.randrange(-4, 9) for _ in range(rng.choice([3, 4]))]) for i in range(240)]
    rows += [(1000 + i, 0, [2, 2, 2, 2]) for i in range(80)]  # a third of all rows are ties
    rows += rows[:30] * 2 + [(1000, 0, [2, 2, 2, 2])] * 20  # repeats
    rows += [(None, 1, [1]), (2000, None, [1]), (2010, 1, None), (2020, 1, [1, None]), (2030, 2, []), (2040, 7, [3, 3, 3, 3])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    for options in ({}, {"anchor_block": 3, "row_slice": 7}):
        got = mined(frame(spark, rows), **options)
        assert len(got) == len(set(got)) and set(got) == want
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(10, 1, [1]), (11, 2, [1])])) == []


def test_ids_that_repeat_with_other_vectors(spark):
    rows = [(10, 1, [4, 0]), (10, 1, [0, 4]), (11, 1, [2, 2]), (12, 2, [2, 1]), (12, 2, [1, 2]), (13, 2, [2, 2])]
    got = mined(frame(spark, rows))
    assert sorted(got) == sorted([
        (10, 11, 1, 12, 8, 8), (10, 11, 2, 13, 8, 8), (10, 11, 1, 12, 8, 8), (10, 11, 2, 13, 8, 8),
    ])


def test_keys_sort_as_packed():
    rng = random.Random(2)
    big = (1 << 63) - 1
    some = [(rng.choice([-big - 1, -3, 0, 5, big]), 4, rng.choice([-big, -1, 0, 7, big]), rng.random() < 0.5, rng.randrange(-9, 9)) for _ in range(400)]
    assert [hn.unpack(hn.pack(*x)) for x in some] == some
    assert sorted(some, key=lambda x: hn.pack(*x)) == sorted(some, key=lambda x: (x[0], x[1], -x[2], x[3], x[4]))


def test_scores_beyond_doubles():
    a, b = np.array([[1 << 40, 1 << 40, 1]]), np.array([[1 << 40, -(1 << 40), 3], [1 << 30, 1, 1], [1 << 62, 1 << 62, 0]])
    assert hn._products(a, b).tolist() == [[3, (1 << 70) % (1 << 70) or (1 << 63) - 1, (1 << 63) - 1]]
    scores = np.array([[(1 << 60) + 1, 1 << 60, (1 << 60) + 2]])
    i, j = hn._best(scores, np.array([3, 2, 1]), np.ones((1, 3), bool), 2)
    assert j.tolist() == [2, 0]


def whitened(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<bigint>, component int, n double")
    return wh.whiten(df).collect()


def test_whitening_equals_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.normal(size=(600, 40)) @ rng.normal(size=(40, 40))).astype(int) + 1_000_000
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (3, x[3].tolist())]
    y = np.vstack([x, x[:1], x[3:4]])
    got = whitened(spark, rows + [(900, None), (901, [1, None])])
    n, mean = len(y), y.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(y.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (y - mean) @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-9
    by = {(r["id"], r["component"]): r for r in got}
    sums = y.sum(axis=0)
    for k in range(32):
        mine = np.array([by[i, k + 1]["whitened"] for i in range(600)])
        sign = np.sign(mine @ want[:600, k])
        assert mine == pytest.approx(sign * want[:600, k], abs=1e-7)
        assert by[0, k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert int(by[5, 1]["deviation"]) == int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[5], sums)))
    assert by[None, 1]["whitened"] == by[0, 1]["whitened"]


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None), (2, [])]) == []
    assert whitened(spark, [(1, [5, 5]), (2, [5, 5])]) == []  # no spread, nothing to divide by
    flat = whitened(spark, [(i, [i, 7, 2 * i]) for i in range(9)])  # one direction only
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    short = whitened(spark, [(1, [3]), (2, [0, 4]), (3, [1, 1]), (4, [3, 0])])
    assert len({r["whitened"] for r in short if r["id"] in (1, 4)}) <= 2 and len(short) == 8
    huge = whitened(spark, [(1, [1 << 60, 0]), (2, [0, 1 << 60]), (3, [0, 0])])
    assert max(r["identity_error"] for r in huge) < 1e-6 and int(huge[0]["deviation"]) > 1 << 63


def test_refinement_reaches_double_precision_in_clusters():
    rng = np.random.default_rng(8)
    for values in (
        np.linspace(9, 1, 30), np.concatenate([[5.0] * 10, [1.0] * 20]), 3 + 1e-9 * np.arange(30), np.geomspace(1e8, 1e-4, 30),
        np.concatenate([2 + 1e-12 * np.arange(15), 1 + 1e-6 * np.arange(15)]), np.zeros(30),
    ):
        q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
        q = q + q @ (np.eye(30) - q.T @ q) / 2  # orthogonal to extended precision
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, x = wh.eigen(a)
        scale = max(float(np.abs(a).max()), 1e-300)
        assert np.abs(x.T @ x - np.eye(30)).max() < 1e-16
        assert np.abs(a @ x - x * found).max() / scale < 1e-16
        assert np.all(found[:-1] >= found[1:])
        assert np.abs(found - np.sort(values)[::-1]).max() / scale < 1e-15
