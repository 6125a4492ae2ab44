"""Spectrum slicing against a plain solver, and whitening against plain sums."""

import math

import numpy as np
import pytest

from fieldcount.llm import spectrum, whitening

RNG = np.random.default_rng(11)
Q = np.linalg.qr(RNG.standard_normal((64, 64)))[0]


@pytest.mark.parametrize(
    "matrix",
    [
        np.cov(RNG.standard_normal((64, 300))),
        np.cov(RNG.standard_normal((64, 10))),  # not of full rank
        np.eye(20),
        np.zeros((4, 4)),
        np.diag([1.0] * 6 + [0.5] * 6 + [0.0] * 6),
        Q * np.array([3.0] * 10 + [0.5] * 30 + [0.0] * 24) @ Q.T,  # equal ones
        Q * 10.0 ** -np.arange(64) @ Q.T,
        Q * (1 + 1e-12 * np.arange(64)) @ Q.T,  # nearly equal ones
        np.array([[2.0]]),
        np.full((2, 2), 1024.0),  # eigenvalues as far from the first shift, on both sides
        1e-9 * np.cov(RNG.standard_normal((150, 400))),  # blocks are eliminated first
    ],
)
def test_leading_pairs(matrix):
    values, vectors = spectrum.leading_eigenpairs(matrix, 32)
    scale = max(np.abs(np.linalg.eigvalsh(matrix)).max(), 1e-300)
    assert len(values) == min(32, len(matrix))
    assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][: len(values)], abs=1e-12 * scale)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_counts_are_the_inertia():
    a = RNG.standard_normal((40, 40))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in (*values + 1e-9, *values - 1e-9, 0.0):
        assert spectrum.count_above(a, shift) == (values > shift).sum()
    assert spectrum.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    big = RNG.standard_normal((300, 300))
    big = big + big.T
    assert spectrum.count_above(big, 3.0) == (np.linalg.eigvalsh(big) > 3.0).sum()


def check(rows, got, components=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == n * min(components, x.shape[1])
    deviation = sorted((i, int(((n * row.astype(object) - sums.astype(object)) ** 2).sum())) for (i, _), row in zip(kept, x))
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(set(deviation))
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    for k in range(1, min(components, x.shape[1]) + 1):
        own = sorted((r for r in got if r.component == k), key=lambda r: r.vec_id)
        plain = (centred @ vectors[:, k - 1] / math.sqrt(values[k - 1]))[np.argsort([i for i, _ in kept], kind="stable")]
        found = np.array([r.whitened for r in own])
        assert min(np.abs(found - plain).max(), np.abs(found + plain).max()) < 1e-7
        assert own[0].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9 and got[0].n == n


def test_against_plain_sums(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(RNG.normal(0.01, 0.2, (300, 40)))]
    rows += [(1000, None), (1001, [None] + [0.5] * 39), (1002, [math.nan] + [0.5] * 39), (1003, [math.inf] + [0.5] * 39)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")
    check(rows, whitening.whiten_embeddings(df.repartition(5)).collect())


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(RNG.normal(0, 3e4, (50, 3)))]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    check(rows, got)
    wide = [(i, [c * 1e9 for c in v]) for i, v in rows]
    found = whitening.whiten_embeddings(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in found)
    assert [r.whitened for r in sorted(found, key=lambda r: (r.component, r.vec_id))] == pytest.approx(
        [r.whitened for r in sorted(got, key=lambda r: (r.component, r.vec_id))], abs=1e-4
    )


def test_equal_few_and_no_vectors(spark):
    schema = "vec_id string, embedding array<float>"
    same = whitening.whiten_embeddings(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), (None, [1.0, 2.0])], schema))
    rows = same.collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows[:2]] == [
        ("a", 1, 3, 0, None, 0.0, 0.0),
        ("a", 2, 3, 0, None, 0.0, 0.0),
    ]
    assert len(rows) == 6
    two = whitening.whiten_embeddings(spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened and abs(r.whitened)) for r in two) == [
        ("a", 1, pytest.approx(1.0)), ("a", 2, None), ("b", 1, pytest.approx(1.0)), ("b", 2, None),
    ]
    for none in ([], [("a", None)], [("a", [])], [("a", [math.nan])]):
        out = whitening.whiten_embeddings(spark.createDataFrame(none, schema))
        assert out.collect() == []
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
