"""Whitening and hard negatives against plain linear algebra and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuework.llm import hard_negatives, whitening
from cuework.llm.vectors import whole_numbers

ROWS = "vec_id long, embedding array<float>, label int, n string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "n", "x") for i, v, k in rows], ROWS).repartition(3)


def plain_whitening(vectors, components=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    r = int((e[:components] > 1e-12 * e[0]).sum())
    return ((n * x - s) ** 2).sum(axis=1), (c @ q[:, :r]) / np.sqrt(e[:r]), e[:r] / e.sum()


def check_whitening(spark, vectors, components=32):
    got = whitening.whiten(table(spark, [(i, v, 0) for i, v in enumerate(vectors)]), components).collect()
    deviation, white, explained = plain_whitening(vectors, components)
    n, r = white.shape
    assert len(got) == n * r
    out = np.zeros((n, r))
    for row in got:
        assert row.n == n and row.deviation == deviation[row.vec_id] and row.identity_error < 1e-9
        assert abs(row.explained / explained[row.component - 1] - 1) < 1e-10
        out[row.vec_id, row.component - 1] = row.whitened
    return out, white


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((80, 40)) * np.linspace(0.2, 3, 40)).tolist()
    out, white = check_whitening(spark, vectors)
    sign = np.sign((out * white).sum(axis=0))
    assert np.abs(out * sign - white).max() < 1e-9


def test_more_dimensions_than_rows_and_repeated_eigenvalues(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, rng.standard_normal((7, 20)).tolist())
    corners = [[s * 2.0 * (i == j) for j in range(6)] for i in range(6) for s in (1, -1)]  # one eigenvalue, six times
    out, _ = check_whitening(spark, corners)
    assert np.abs(out.T @ out / len(out) - np.eye(6)).max() < 1e-12


def test_bidiagonalisation_stops_early_and_is_whole():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 120)) * np.r_[np.linspace(50, 30, 8), np.full(112, 1e-3)]
    steps = []

    def step(w):
        steps.append(1)
        u = x @ w
        return x.T @ u, float(u @ u)
    s, v = whitening.bidiagonalise(step, 120, float((x ** 2).sum()), 8)
    want = np.linalg.svd(x)[1]
    assert np.abs(s[:8] / want[:8] - 1).max() < 1e-12 and len(steps) < 60
    assert np.abs(v[:, :8].T @ v[:, :8] - np.eye(8)).max() < 1e-12


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [], 0), (6, [1.0, 2.0, 3.0], 0),
           (7, [1e30, 0.0], 0)]
    fine = [(None, [0.0, 1.0], 0), (9, [1.0, 0.5], None), (9, [1.0, 0.5], None), (10, [-1.0, 0.25], 1)]
    got = whitening.whiten(table(spark, odd + fine)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted(
        (str(i), c) for i in (None, 9, 9, 10) for c in (1, 2)) and {r.n for r in got} == {4}
    assert whitening.whiten(table(spark, odd[:5])).count() == 0
    assert whitening.whiten(table(spark, fine).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0
    assert whole_numbers(table(spark, odd + fine), "embedding", 64).count() == 4


def test_deviation_is_exact_or_refused():
    big = whitening.Centre(np.array([0, 0]), 10**5)
    assert big.deviation(np.array([[20_000, 3]])).tolist() == [(10**5 * 20_000) ** 2 + (3 * 10**5) ** 2]
    with pytest.raises(OverflowError):
        big.deviation(np.array([[10**6, 10**6]]))


def mined_by_force(rows, every=10, positives=5, negatives=10, low=30, high=90):
    x = {n: [math.floor(256 * float(np.float32(c))) for c in v] for n, (_, v, _) in enumerate(rows)}
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i % every:
            continue
        score = {n: sum(p * q for p, q in zip(x[a], x[n])) for n in x}
        order = sorted(x, key=lambda n: (-score[n], rows[n][0]))
        for p in [n for n in order if n != a and rows[n][2] == label][:positives]:
            fit = [n for n in order if rows[n][2] != label and low * score[p] <= 100 * score[n] <= high * score[p]]
            out += [(i, rows[p][0], k, rows[n][0], score[p], score[n]) for k, n in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mine(spark, rows, **more):
    return sorted(map(tuple, hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, **more).collect()))


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) + 0.8).tolist(), int(rng.integers(3))) for i in range(300)]
    want = mined_by_force(rows)
    assert mine(spark, rows) == want and len(want) > 500
    from cuework.llm import vectors
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 8 * 8 * 4)
    monkeypatch.setattr(vectors.in_blocks, "__defaults__", (None, 8 * 8 * 16))
    assert mine(spark, rows) == want


def test_hard_negatives_ties_and_repeats(spark):
    rng = random.Random(7)
    rows = [(i // 2, [float(rng.choice([-0.5, 0.25, 0.5, 1.0])) for _ in range(3)], rng.randrange(2)) for i in range(120)]
    rows += rows[20:24] * 3 + rows[:1] * 8  # copies, of anchors too; more copies than positives
    assert mine(spark, rows, negatives=4) == mined_by_force(rows, negatives=4)


def test_hard_negatives_odd_rows(spark):
    nan = float("nan")
    odd = [(None, [1.0, 1.0], 1), (10, [1.0, 1.0], None), (20, None, 1), (30, [nan, 1.0], 1), (40, [1.0], 1), (50, [], 2)]
    fine = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.1], 2), (60, [-1.0, 0.0], 3), (61, [1.0, 0.0], 3)]
    want = [(0, 1, 1, 2, 256 * 256, 128 * 256)]
    assert mine(spark, odd + fine) == want == mined_by_force(fine)
    assert mine(spark, odd[:2]) == [] and mine(spark, [(1, [1.0], 1)]) == [] and mine(spark, [(10, [1.0], 1)]) == []


def test_large_scores():
    a = np.array([[1 << 30, 3], [1, 1 << 30]])
    s, bound = hard_negatives.scores(a, a)
    assert s.tolist() == (a @ a.T).tolist() and bound >= 1 << 53
    at, real = hard_negatives.best(s, bound, np.array([[True, True], [False, True]]), 1)
    assert at.tolist() == [[0], [1]] and real.all()
    with pytest.raises(OverflowError):
        hard_negatives.scores(a * 4, a * 4)
