"""Nearest neighbours from randomly rotated one-bit codes.

Vectors are centred, normalised and rotated at random; the signs of the rotated components, packed into bits, are the code. With two
scalars for each vector the bits give an unbiased estimate of an inner product and a bound of its error. A query only computes exact
distances to vectors whose lower bound is not above a limit: the k-th smallest distance measured so far. Every vector is coded and
looked at; chunks of queries meet chunks of vectors, block by block, and the best of each chunk are merged. A chunk is as large as a
task can hold, since the bytes shuffled are queries times vectors, divided by the size of a chunk. Originals travel with their chunk:
in few dimensions one-bit bounds leave most vectors to be measured, and a later join would carry a row for each of these pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import quoted, table

#: Vectors that are coded together, the seed of the rotation, and the error bound in standard deviations of the estimate.
BLOCK, SEED, DEVIATIONS = 4096, 7, 4.0
#: Bytes of the vectors, as doubles, in a chunk of vectors and in a chunk of queries.
CHUNK = 1 << 24
#: Pairs of vectors that are gathered at once for exact distances.
PAIRS = 1 << 13


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class OneBitCodes:
    """Codes of the rows of vectors around their centre."""

    def __init__(self, vectors: np.ndarray, rotate: np.ndarray):
        dim = vectors.shape[1]
        self.rotate, self.root = rotate, np.sqrt(dim)
        self.centre = vectors.mean(axis=0)
        residual = vectors - self.centre
        self.norms = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(self.norms > 0, self.norms, 1.0)[:, None]) @ rotate
        self.bits = np.packbits(turned >= 0, axis=1)
        # Inner product of a unit vector with its own code: how much of it the code keeps.
        self.kept = np.abs(turned).sum(axis=1) / self.root
        self.dim = dim

    def bounds(self, queries: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of each query to each vector."""
        residual = queries - self.centre
        length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(length > 0, length, 1.0)[:, None]) @ self.rotate
        signs = np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32)
        # Sum over set bits and over all: signs are 2 * bit - 1.
        dots = (2 * (turned.astype(np.float32) @ signs.T).astype(np.float64) - turned.sum(axis=1)[:, None]) / self.root
        kept = np.where(self.kept > 0, self.kept, 1.0)
        estimate = dots / kept
        slack = deviations * np.sqrt(np.maximum(1 - kept**2, 0)) / kept / np.sqrt(max(self.dim - 1, 1)) + 1e-6
        scale = 2 * length[:, None] * self.norms
        base = length[:, None] ** 2 + self.norms**2
        return base - scale * np.minimum(estimate + slack, 1.0), base - scale * np.maximum(estimate - slack, -1.0)


def exact_distances(a: np.ndarray, of: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows a[of] to b[at], summed from the first component on, a portion of pairs at a time."""
    out = np.empty(len(of))
    for start in range(0, len(of), PAIRS):
        square = a[of[start : start + PAIRS]] - b[at[start : start + PAIRS]]
        square *= square
        out[start : start + PAIRS] = np.sqrt(np.add.accumulate(square, axis=1)[:, -1])
    return out


def search_block(vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_own: np.ndarray, k: int, deviations: float, limits: np.ndarray) -> pd.DataFrame:
    """Those of one block's vectors that may be among the k nearest to each query, its own row left out; at most k for a query.

    ``own`` and ``query_own`` identify rows, as ids may repeat. The k vectors of the least upper bounds are measured first; the largest
    of their distances is the limit that lower bounds of others are held against. ``limits`` has each query's squared limit from blocks
    before; smaller ones are written into it.
    """
    out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
    codes = OneBitCodes(vectors, rotation(vectors.shape[1]))
    for at in range(0, len(queries), 64):
        part, same = queries[at : at + 64], (query_own[at : at + 64, None] == own[None, :]) & (query_ids[at : at + 64, None] == ids[None, :])
        low, high = codes.bounds(part, deviations)
        low[same], high[same] = np.inf, np.inf
        near = min(k, len(ids))
        first = np.argpartition(high, near - 1, axis=1)[:, :near]
        q = np.repeat(np.arange(len(part)), near)
        score = np.where(same[q, first.reshape(-1)], np.inf, exact_distances(part, q, vectors, first.reshape(-1)))
        limit = limits[at : at + 64]
        if near == k:
            np.minimum(limit, score.reshape(len(part), near).max(axis=1) ** 2 * (1 + 1e-9), out=limit)
        q, v = np.nonzero((low <= limit[:, None]) & ~same)
        score = exact_distances(part, q, vectors, v)
        order = np.lexsort((ids[v], score, q))
        q, v, score = q[order], v[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kth = rank == k - 1
        limit[q[kth]] = np.minimum(limit[q[kth]], score[kth] ** 2 * (1 + 1e-9))
        best = (rank < k) & (score**2 <= limit[q])
        out["query"].append(at + q[best])
        out["vec_id"].append(ids[v[best]])
        out["score"].append(score[best])
    return pd.DataFrame({c: np.concatenate(x) if x else np.empty(0) for c, x in out.items()})


def search_chunk(vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_own: np.ndarray, k: int, deviations: float) -> pd.DataFrame:
    """query (its place in queries), vec_id, score of the k nearest of a chunk's vectors to each query, block by block; what earlier
    blocks measured limits later ones."""
    limits = np.full(len(queries), np.inf)
    found = pd.DataFrame({"query": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    for at in range(0, len(ids), BLOCK):
        part = slice(at, at + BLOCK)
        new = search_block(vectors[part], ids[part], own[part], queries, query_ids, query_own, k, deviations, limits)
        found = pd.concat([found, new], ignore_index=True).sort_values(["query", "score", "vec_id"], ignore_index=True)
        found = found[found.groupby("query").cumcount() < k]
    return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, row, vector of the rows that take part: none with a null id, and none with a vector that is null, zero or has a component
    that is null or not finite.

    row identifies a row. It is a hash of id, vector and the number of the copy, so rows of one id are told apart, equal ones too, and
    a task that runs again gives the same.
    """
    of = vectors.schema[vector_col].dataType
    kept = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)  # exact as it is, and half as wide
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<float>" if kept else "array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    counted = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.select("vec_id", "vector", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return copies.select("vec_id", F.xxhash64("vec_id", "vector", "copy").alias("row"), "vector")


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", deviations: float = DEVIATIONS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of each row that is_query (a condition on vec_id) picks.

    Every usable row is a candidate and, if picked, a query, rows of one id and equal rows too; only a query's own row is none of its
    neighbours. Ties go to the smaller id. Vectors are compared with those of their own length. Fewer candidates give fewer rows.
    Queries are copied to every chunk of vectors and vectors to every chunk of queries, so a task holds one chunk of each. Chunks are
    smaller than they may be where that gives every core one.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("dim", F.size("vector"))
    counted = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    per_chunk = F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / (8 * F.col("dim"))))
    spread = F.least(F.lit(vectors.sparkSession.sparkContext.defaultParallelism), F.ceil(F.col("n") / BLOCK))
    chunks = F.greatest(F.ceil(F.col("n") / per_chunk), spread).cast("int").alias("chunks")
    dims = counted.where("q > 0").select("dim", chunks, F.ceil(F.col("q") / per_chunk).cast("int").alias("sets"))
    rows = rows.join(dims, "dim")
    chunk, of = F.pmod("row", F.col("chunks")).cast("int"), F.pmod(F.xxhash64("row"), F.col("sets")).cast("int")
    columns = ["dim", "chunk", "of", "vec_id", "row", "vector"]
    held = rows.withColumn("chunk", chunk).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).select(*columns).toDF(*columns)
    asked = rows.where(is_query).withColumn("of", of).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*columns).toDF(*columns)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_row", "vec_id")} | {"score": pd.Series(dtype="float64")})
        values = [np.stack(side["vector"].to_list()).astype(np.float64) for side in (left, right)]
        found = search_chunk(values[0], left["vec_id"].to_numpy(), left["row"].to_numpy(), values[1], right["vec_id"].to_numpy(), right["row"].to_numpy(), k, deviations)
        at = found["query"].to_numpy(np.int64)
        return pd.DataFrame({"query_id": right["vec_id"].to_numpy()[at], "query_row": right["row"].to_numpy()[at], "vec_id": found["vec_id"].to_numpy(np.int64), "score": found["score"].to_numpy()})

    keys = ["dim", "chunk", "of"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, query_row long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others of each row whose id is divisible by 100, as ``nearest`` gives them: unusable vectors and rows without an id
    take no part, rows of repeated ids are rows of their own, ties go to the smaller id, and an empty table gives no rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.r AS query, c.r, q.vec_id AS query_id, c.vec_id, i, (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) AS s
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) CROSS JOIN LATERAL (SELECT unnest(range(1, len(q.e) + 1)) AS i) WHERE q.vec_id % 100 = 0),
scored AS (SELECT query, query_id, vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list(s ORDER BY i)), lambda a, x: a + x)) AS score FROM pairs GROUP BY query, r, query_id, vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
