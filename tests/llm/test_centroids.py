import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import centroids


def slow(rows, k, rounds, dim, scale):
    """Every distance, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-centroids.limit(dim), min(centroids.limit(dim), math.floor(scale * c))) for c in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(nearest(x)[1], []).append(x)
        for c, xs in own.items():
            centres[c] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    per = {}
    for _, c, d in found:
        per[c] = per.get(c, 0) + d
    held = lambda s: min(s, 2**63 - 1)
    return [(i, c, d, held(per[c]), held(sum(per.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((7, 8)) * 2
    rows = [(i, [float(np.float32(x)) for x in middles[i % 7] + 0.4 * rng.standard_normal(8)]) for i in range(300)]
    rows += [(3, rows[3][1])] * 4 + [(3, rows[9][1]), (None, rows[5][1]), (None, rows[6][1])]  # repeated rows and ids, null ids
    rows += [(900, None), (901, [None] + [1.0] * 7), (902, [math.nan] + [1.0] * 7), (903, [math.inf] * 8), (904, []), (905, [1.0]), (906, [1.0] * 9), (907, [-0.01] * 8), (908, [0.0] * 8)]
    rows += [(909, [3e38] * 8), (910, [-3e38] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("X", F.lit(1)).repartition(3)


@pytest.mark.parametrize("k,rounds", [(6, 3), (16, 3), (1, 2), (400, 1), (6, 0)])
def test_against_every_distance(frame, k, rounds):
    rows, df = frame
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    found = centroids.clustered(df, k=k, rounds=rounds, dim=8)
    assert in_order(tuple(r) for r in found.collect()) == in_order(slow(rows, k, rounds, 8, 64))


def test_bounds_never_exceed_distances_and_save_most():
    rng = np.random.default_rng(5)
    middles = rng.integers(-900, 900, (16, 8))
    x = middles[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    pivots = centroids.chosen_pivots(middles)
    bounds = centroids.Bounds(middles, pivots)
    seen = centroids.pivot_distances(x, pivots)
    true = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    low = bounds.lower(seen)
    assert (low**2 <= true).all() and len(pivots) == centroids.PIVOTS
    cluster, distance, measured = bounds.nearest(x, seen)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert measured < 0.3 * true.size


def test_bounds_of_large_and_equal_points():
    most = centroids.limit(8)
    x = np.array([[most] * 8, [-most] * 8, [0] * 8, [0] * 8, [most] * 7 + [most - 1]])
    bounds = centroids.Bounds(x, centroids.chosen_pivots(x))
    cluster, distance, _ = bounds.nearest(x, centroids.pivot_distances(x, centroids.chosen_pivots(x)))
    assert cluster.tolist() == [0, 1, 2, 2, 4] and distance.tolist() == [0] * 5
    assert centroids.chosen_pivots(np.zeros((3, 8), np.int64)).shape == (1, 8)


def test_nothing_usable(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    useless = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    for df in (empty, useless):
        found = centroids.clustered(df)
        assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_rows(spark):
    df = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    assert {tuple(r)[1:5] for r in centroids.clustered(df).collect()} == {(0, 0, 0, 0)}
