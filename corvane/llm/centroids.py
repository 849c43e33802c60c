"""Clusters around centroids, on integer vectors, with most distances left unmeasured by Ptolemaic bounds.

For points q, c and pivots s, t Ptolemy's inequality gives d(q, c) * d(s, t) >= |d(q, s) * d(c, t) - d(q, t) * d(c, s)|. The distances
of every vector to a few pivots are kept beside it for all rounds; those of the centroids are computed anew each round, and the best of
the fixed pairs of pivots bounds each distance from below. A bound is lowered by more than the rounding of its terms, so it never
exceeds the true distance; whatever it doesn't rule out is measured exactly in integers. A round is one pass over the vectors that
shuffles nothing but sums: one row for each centroid and task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import quoted, shared_dir, table, written

#: Pivots, whose pairs all give a bound; vectors that a task looks at together.
PIVOTS, BLOCK = 6, 4096
#: One part in 2^49: more than the rounding of the products, quotients and roots of a bound together.
SLACK = 8 * np.finfo(np.float64).eps


def limit(dim: int) -> int:
    """Components are held within this size, so that a squared distance always fits 63 bits."""
    return math.isqrt((2**63 - 1) // max(dim, 1)) // 2


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, x (array of int: floor(scale * component), held within ``limit``) of the rows with exactly dim finite components."""
    most = float(limit(dim))
    v = F.col(quoted(vector_col)).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * F.lit(float(scale))))).cast("int"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, dim: int, dtype=np.int64) -> np.ndarray:
    """The rows of a list column of lists of dim values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b, pair by pair."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def chosen_pivots(points: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Distinct rows of points, each the farthest from those before (the first of equally far ones)."""
    taken, far = [0], squared(points, points[:1])
    while len(taken) < most and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, squared(points, points[taken[-1:]]))
    return points[taken]


class Bounds:
    """Centroids as pivots see them."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.pairs = list(combinations(range(len(pivots)), 2))
        self.seen = pivot_distances(centroids, pivots)
        self.apart = {(s, t): math.sqrt(int(squared(pivots[s : s + 1], pivots[t : t + 1])[0])) for s, t in self.pairs}

    def lower(self, seen: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of each vector, given by its pivot distances, to each centroid."""
        low = np.zeros((len(seen), len(self.centroids)))
        for s, t in self.pairs:
            one, other = seen[:, s : s + 1] * self.seen[:, t], seen[:, t : t + 1] * self.seen[:, s]
            np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / self.apart[s, t], out=low)
        return low * (1 - SLACK)

    def nearest(self, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were measured."""
        low = self.lower(seen)
        at = np.arange(len(x))
        guess = low.argmin(axis=1)
        best = squared(x, self.centroids[guess])
        open_ = low * low * (1 - SLACK) <= best[:, None].astype(np.float64)
        open_[at, guess] = False
        found = np.full(low.shape, np.iinfo(np.int64).max)
        found[at, guess] = best
        rows, those = np.nonzero(open_)
        found[rows, those] = squared(x[rows], self.centroids[those])
        cluster = found.argmin(axis=1)
        return cluster, found[at, cluster], len(x) + len(rows)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def blocks(batches: Iterator[pa.RecordBatch], dim: int, n_pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of vec_id, x, seen in portions."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column(1), dim), matrix(part.column(2), n_pivots, np.float64)


def with_pivot_distances(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points (vec_id, x) with seen, the distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pivot_distances(matrix(batch.column(1), pivots.shape[1]), pivots)
            offsets = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * seen.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(seen.reshape(-1)))], names=["vec_id", "x", "seen"])

    return points.mapInArrow(run, "vec_id long, x array<int>, seen array<double>")


def cluster_sums(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that is nearest to any vector: how many, and the exact sum of each component."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, n, sums = Bounds(centroids, pivots), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x, seen in blocks(batches, dim, len(pivots)):
            cluster, _, _ = bounds.nearest(x, seen)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, x)
        own = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own], pa.int64()), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = points.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # k * dim rows
        out.setdefault(r.cluster, (r.n, [0] * dim))[1][r.i] = int(r.s)
    return out


def assigned(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centroids, pivots)
        for part, x, seen in blocks(batches, dim, len(pivots)):
            cluster, distance, _ = bounds.nearest(x, seen)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return points.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row with exactly dim finite components.

    A component becomes floor(scale * component). The k rows whose id, put after the seed, has the smallest SHA-256 are the first
    centroids (all rows, if fewer; rows of one id by their vectors; null ids last). Each round moves every centroid that is nearest to
    any vector to floor(mean) of its vectors, and then vectors are assigned once more; ties go to the smaller number. Repeated rows
    are rows of their own. No usable row gives no rows. Components beyond ``limit(dim)`` are held there, and an inertia above
    2^63 - 1 reads as that. k and dim are parameters: only k * dim numbers a round reach the driver.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, dim, scale)
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], StructType.fromDDL(columns))
    centroids = np.array([r.x for r in first], dtype=np.int64)
    pivots = chosen_pivots(centroids)
    points = written(with_pivot_distances(kept, pivots), shared_dir(spark))
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(points, centroids, pivots).items():
            centroids[c] = [s // n for s in sums]
    found = written(assigned(points, centroids, pivots), shared_dir(spark))
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda s: min(s, 2**63 - 1)
    about = [(c, held(s), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(about), "cluster").select([c.split(" ")[0] for c in columns.split(", ")])


def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings as ``clustered`` gives them: 16 centroids, 3 rounds and a last assignment. Rows whose vector is null,
    of another length, or holds null or non-finite components are left out; repeated rows, null ids and other columns do no harm."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM kept) WHERE c < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT row, vec_id, x, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, c) AS place FROM (
      SELECT v.row, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept v CROSS JOIN c{r} c))
  WHERE place = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS x
    FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY 1, 2) GROUP BY c) m ON m.c = o.c)"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


OP12_SQL = _sql()
