import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import whitening


def found_rows(df, **options):
    return [tuple(r) for r in whitening.whitened(df, **options).collect()]


def integers(rows, scale=64, offset=1_000_000):
    return np.array([[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in rows], dtype=object)


def check(found, rows, most, tolerance=1e-6):
    """Against the eigenvectors of a covariance summed in Python fractions' integers."""
    x = integers(rows)
    n, d = x.shape
    sums = x.sum(axis=0)
    wide = x * n - sums
    covariance = (wide.T @ wide).astype(np.float64) / float(n) ** 3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-13 * values[0]).sum()))
    want = (wide.astype(np.float64) / n) @ vectors[:, :rank] / np.sqrt(values[:rank])
    deviation = [int(s) for s in (wide * wide).sum(axis=1)]
    assert len(found) == n * rank
    got = {}
    for i, c, count, dev, w, explained, error in found:
        assert count == n and error <= 1e-4
        assert explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
        got.setdefault((i, dev), {})[c] = w
    signs = None
    for (i, _), row, dev in zip(rows, want, deviation):
        w = np.array([got[i, dev][c + 1] for c in range(rank)])
        if signs is None:
            signs = np.sign(w * row)
        assert np.abs(w - signs * row).max() < tolerance


def test_against_the_covariance(spark):
    rng = np.random.default_rng(6)
    mixing = rng.standard_normal((12, 12)) * np.array([9.0, 7, 5, 4, 3, 2.5, 2, 1.5, 1, 0.7, 0.4, 0.2])
    rows = [(i, [float(np.float32(c)) for c in mixing @ rng.standard_normal(12)]) for i in range(500)]
    useless = [(900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, [])]
    df = spark.createDataFrame(rows + useless, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("X", F.lit(1)).repartition(3)
    check(found_rows(df), rows, 32)
    check(found_rows(df, most=5), rows, 5)


def test_dependent_and_constant_entries(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(200):
        a, b = rng.standard_normal(2) * 5
        a, b = math.floor(64 * a) / 64, math.floor(64 * b) / 64
        rows.append((i, [a, b, a + b, 2 * a, 7.0, -3.25]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    check(found_rows(df), rows, 32)


def test_small_directions_are_kept(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.integers(-(2**21), 2**21, 3)] + [float(rng.integers(0, 2)) / 64]) for i in range(300)]
    found = found_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r[1] for r in found} == {1, 2, 3, 4} and found[0][6] < 1e-4


def test_other_lengths_are_fitted_apart_and_repeats_count(spark):
    rng = np.random.default_rng(9)
    long, short = ([(i, [float(np.float32(c)) for c in rng.standard_normal(d)]) for i in range(m)] for m, d in ((60, 5), (40, 3)))
    long += [long[0]] * 3
    df = spark.createDataFrame(long + [(1000 + i, v) for i, v in short] + [(None, long[1][1])], "vec_id long, embedding array<float>")
    found = found_rows(df)
    assert len(found) == 64 * 5 + 40 * 3 and {r[2] for r in found} == {64, 40}
    assert sum(r[0] is None for r in found) == 5
    assert sum(r[0] == 0 for r in found) == 4 * 5


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None), (2, [])]):
        df = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [5.0, 3.0]), (3, [6.0, 9.0])]
    found = found_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r[0] for r in found} == {0, 1, 2, 3} and all(math.isfinite(r[4]) for r in found)
    assert {r[3] for r in found if r[0] < 2} == {2**63 - 1}


def test_deviations_are_exact():
    rng = np.random.default_rng(10)
    x = rng.integers(-(2**40), 2**40, (50, 4))
    n, sums = 50, [int(s) for s in x.astype(object).sum(axis=0)]
    parts = [divmod(s, n) for s in sums]
    centre = whitening.Centre(n, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]))
    want = [min(sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)), 2**63 - 1) for row in x]
    assert centre.deviations(x) == want
    small = x // 2**30
    sums = [int(s) for s in small.sum(axis=0)]
    centre = whitening.Centre(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]))
    assert centre.deviations(small) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in small]
