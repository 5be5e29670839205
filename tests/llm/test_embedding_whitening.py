"""Whitening against dense eigenvalues, and whole numbers against Python's."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.llm import embedding_whitening as ew


def exact(rows):
    """n, S, V as doubles from exact integers, of (vec_id, vector) rows that are kept."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, sums = len(kept), [sum(col) for col in zip(*(x for _, x in kept), strict=True)]
    apart = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept], object)
    matrix = apart.T @ apart
    return kept, n, sums, np.array([[v / n**3 for v in line] for line in matrix], float), (apart**2).sum(axis=1)


def close_to_brute(found, rows, most=32):
    kept, n, sums, matrix, apart = exact(rows)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    x = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for _, v in kept], float)
    z = x @ vectors / np.sqrt(values)
    ids = [i for i, _ in kept]
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == len(kept) * len(values)
    mine = np.array([[got[i, k + 1].whitened for k in range(len(values))] for i in ids])
    signs = np.sign((mine * z).sum(axis=0))
    assert np.allclose(mine, z * signs, atol=1e-7)
    assert all(got[i, 1].deviation == a and got[i, 1].n == n for i, a in zip(ids, apart.tolist(), strict=True))
    assert all(math.isclose(got[ids[0], k + 1].explained, v / np.trace(matrix), rel_tol=1e-9) for k, v in enumerate(values))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


def normal(seed, n, d, falling=0.8):
    scale = 10 * falling ** np.arange(d)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return (np.random.default_rng(seed + 1).standard_normal((n, d)) * scale @ turn).tolist()


def test_equals_dense_eigenvalues_and_drops_defects(spark):
    rows = list(enumerate(normal(1, 300, 40)))
    bad = [(1000, None), (1001, []), (1002, [None] * 40), (1003, [float("nan")] * 40), (1004, [float("inf")] + [0.0] * 39), (1005, [1.0] * 12)]
    repeated = [(2000 + i, rows[5][1]) for i in range(150)]
    docs = spark.createDataFrame(rows + bad + repeated, "vec_id long, embedding array<double>")
    docs = docs.withColumn("x", F.lit("clash")).withColumn("component", F.lit(1)).repartition(5)
    close_to_brute(ew.report(docs).collect(), rows + repeated)


def test_fewer_dimensions_than_components(spark):
    rows = list(enumerate(normal(3, 90, 5, 0.1)))
    found = ew.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    close_to_brute(found, rows, 5)


def test_rows_that_repeat_stay(spark):
    rows = list(enumerate(normal(4, 30, 4))) * 2
    found = ew.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 60 * 4 and found[0].n == 60 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_gives_no_rows(spark, rows):
    found = ew.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues(spark):
    """A tie across all components: any orthonormal basis whitens."""
    rows = [(i * 2 + s, [(1.0 if s else -1.0) * (k == i) * 50 for k in range(12)]) for i in range(12) for s in (0, 1)]
    found = ew.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 24 * 12 and found[0].identity_error < 1e-9


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float((i % 7) * 1e9), float(i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, _, _, _, apart = exact(rows)
    whole = {r.vec_id: int(r.deviation) for r in ew.whiten(frame).collect()}
    assert [whole[i] for i in range(40)] == apart.tolist()
    assert {r.deviation for r in ew.report(frame).collect()} <= {a if a < 1 << 63 else None for a in apart.tolist()}


def test_products_are_exact():
    draw = random.Random(1)
    for bits in (6, 20, 30, 52):
        y = [[draw.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(40)]
        expected = [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
        assert ew.gram(np.array(y, np.int64)).tolist() == expected


def test_slices_hold_what_they_say():
    matrix = np.cov(np.array(normal(9, 200, 50)).T)
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    done = 0
    for low, high, count in ew.spectrum(matrix, 32):
        assert ((values > low) & (values <= high)).sum() == count
        found, vectors = ew.contour(matrix, low, high, count)
        assert np.allclose(np.sort(found)[::-1], values[done : done + count], rtol=1e-10)
        assert np.allclose(vectors.T @ vectors, np.eye(count), atol=1e-10)
        done += count
    assert done >= 32
    for shift in (values[3] + 1e-6, values[20] - 1e-9, 0.0):
        assert ew.inertia(ew.tridiagonal(matrix), shift) == (values > shift).sum()
