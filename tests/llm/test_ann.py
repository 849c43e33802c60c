import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import ann


def slow(rows, asks, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, own) in enumerate(fine):
        if asks(q):
            near = sorted((math.dist(own, v), i) for n, (i, v) in enumerate(fine) if n != at and len(v) == len(own))
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((9, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + 0.3 * rng.standard_normal(24)]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 24), (602, [None, 1.0]), (603, [float("nan")] * 24), (604, []), (605, [1.0, 2.0]), (700, [1.0, 2.0]), (610, rows[3][1]), (620, rows[3][1]), (None, [1.0] * 24), (710, [math.inf] * 24)]
    rows += [(20, rows[20][1])] * 2 + [(20, rows[21][1]), (30, rows[20][1]), (31, rows[31][1])]  # equal rows, and rows of one id that differ
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("extra", F.lit(1)).repartition(3)
    for block, chunk in ((64, 1 << 24), (64, 64 * 24 * 8), (4096, 1 << 24)):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "CHUNK", chunk)
        found = [tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect()]
        want = slow(rows, lambda i: i % 10 == 0, 10)
        assert len(found) == len(want)
        told, due = (Counter((q, v, round(d, 9)) for q, _, v, d in x) for x in (found, want))
        assert sum((told & due).values()) >= 0.99 * len(want)
        exact = {(q, v, round(d, 9)) for q, _, v, d in slow(rows, lambda i: i % 10 == 0, len(rows))}
        assert all((q, v, round(d, 9)) in exact for q, _, v, d in found)


def test_rows_of_one_id_are_candidates(spark):
    one = spark.createDataFrame([(1, [1.0, 2.5]), (1, [9.0, 9.0]), (10, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(one, F.col("vec_id") % 10 == 0).orderBy("rank").collect()] == [(10, 1, 1), (10, 2, 1)]
    two = spark.createDataFrame([(2, [1.0]), (2, [1.0]), (10, [3.0]), (10, [3.0])], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in ann.nearest(two, F.col("vec_id") % 10 == 0).collect())
    assert found == sorted([(10, 1, 10, 0.0), (10, 2, 2, 2.0), (10, 3, 2, 2.0)] * 2)


def test_bounds_hold_and_choose_few():
    rng = np.random.default_rng(2)
    vectors, queries = rng.standard_normal((500, 48)), rng.standard_normal((20, 48))
    low, high = ann.OneBitCodes(vectors, ann.rotation(48)).bounds(queries, 3.0)
    true = ((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    assert np.mean((low <= true + 1e-9) & (true <= high + 1e-9)) > 0.99


def test_default_bounds_hold_nearly_always():
    rng = np.random.default_rng(3)
    vectors, queries = rng.standard_normal((2000, 48)), rng.standard_normal((50, 48))
    low, high = ann.OneBitCodes(vectors, ann.rotation(48)).bounds(queries, ann.DEVIATIONS)
    true = ((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    assert np.mean((low <= true + 1e-9) & (true <= high + 1e-9)) > 0.999


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone, F.col("vec_id") % 10 == 0).collect() == []
