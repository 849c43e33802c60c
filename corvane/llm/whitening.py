"""Whitening of vectors by shifted CholeskyQR over distributed Gram passes.

Each pass reads the rows once: a task centres its rows exactly, solves them through the triangular factors found so far, and adds up
the Gram matrix of what comes out; tasks send one row for each row of a matrix. The driver factors the sum (Cholesky; with a shift in
the first pass, and later where a direction has nothing in it), which gives one more factor, until the rows are orthonormal. The product
of the factors is the R of a QR decomposition of all rows; its singular values and vectors are the components. The squared matrix is
thus never asked for small directions, as a plain covariance would be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import quoted, shared_dir, table, written

#: Most Gram passes, and how far from the identity the last may be.
PASSES, CLOSE = 5, 1e-10
#: Rows whose products are summed in one step; longer sums are sums of these.
STEP = 1 << 13
#: A direction with less than this part of the largest singular value holds rounding only.
RANK = 1e-10
#: Integers are held within this size.
MOST = 2.0**60

Matrices = dict[int, np.ndarray]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """vec_id, x (array of long: floor(scale * entry) + offset) of the rows whose vector has finite entries only."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * F.lit(float(scale))))).cast("long") + F.lit(offset))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), x.alias("x"))


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of vec_id, x in portions of one length, empty ones left out, with their matrix."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            own = batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))
            for at in range(0, own.num_rows, STEP):
                part = own.slice(at, STEP)
                yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def folded(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray | None], dtype: str = "double") -> Matrices:
    """For each length of vectors the sum of part(x) over portions x of all rows; part gives a matrix of one shape for a length.

    Sums of a task leave it row by row, and equal rows meet in one task, so nothing holds more than one matrix for each length.
    """
    kind = np.float64 if dtype == "double" else np.int64

    def emitted(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        for at in range(0, len(keys), 256):
            own = keys[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.int32()), pa.array([k[1] for k in own], pa.int32()), pa.array([sums[k] for k in own], pa.list_(pa.from_numpy_dtype(kind)))], names=["dim", "i", "values"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Matrices = {}
        for _, x in by_length(batches):
            new = part(x)
            if new is not None:
                sums[x.shape[1]] = sums[x.shape[1]] + new if x.shape[1] in sums else new
        yield from emitted({(dim, i): row for dim, m in sums.items() for i, row in enumerate(m)})

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                new = values.values.to_numpy(zero_copy_only=False)
                sums[dim, i] = sums[dim, i] + new if (dim, i) in sums else new
        yield from emitted(sums)

    schema = f"dim int, i int, values array<{dtype}>"
    found: dict[int, list] = {}
    for r in rows.mapInArrow(within, schema).repartition("dim", "i").mapInArrow(between, schema).collect():
        found.setdefault(r.dim, []).append((r.i, r["values"]))
    return {dim: np.array([v for _, v in sorted(m)], dtype=kind) for dim, m in found.items()}


@dataclass
class Centre:
    """Exact mean of n integer rows: whole + part / n, with part from 0 to n - 1."""

    n: int
    whole: np.ndarray
    part: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - sum, exactly; None where 62 bits can't hold it."""
        apart = x - self.whole
        return apart * self.n - self.part if self.n * (int(np.abs(apart).max(initial=0)) + 1) < 2**62 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        exact = self.scaled(x)
        return exact / self.n if exact is not None else (x - self.whole).astype(np.float64) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - sum)^2, held at 2^63 - 1."""
        exact = self.scaled(x)
        if exact is not None and int(np.abs(exact).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return np.einsum("ij,ij->i", exact, exact).tolist()
        wide = (x - self.whole).astype(object) * self.n - self.part.astype(object)
        return [min(int(s), 2**63 - 1) for s in (wide * wide).sum(axis=1)]


def centres(rows: DataFrame) -> dict[int, Centre]:
    """For each length the exact mean of its rows."""

    def part(x: np.ndarray) -> np.ndarray:  # high and low halves of 30 bits, so that sums of up to 2^32 rows fit
        return np.stack([np.full(x.shape[1], len(x), np.int64), (x >> 30).sum(axis=0), (x & (2**30 - 1)).sum(axis=0)])

    out = {}
    for dim, (count, high, low) in folded(rows, part, "bigint").items():
        n = int(count[0])
        parts = [divmod((int(h) << 30) + int(w), n) for h, w in zip(high, low, strict=True)]
        out[dim] = Centre(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))
    return out


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q @ r = a, r upper triangular, one column after the other."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def upper_factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular r with r.T @ r = gram, or gram plus a shift in the first pass and where gram has no such factor."""
    d = len(gram)
    if not first:
        try:
            r = np.linalg.cholesky(gram).T
            if np.diag(r).min() > 1e-6 * np.diag(r).max():
                return r
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (min(n, STEP) * d + d * (d + 1)) * np.finfo(np.float64).eps / 2 * max(np.linalg.eigvalsh(gram)[-1], np.finfo(np.float64).tiny)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


@dataclass
class Components:
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue, and the variance of all directions."""

    vectors: np.ndarray
    values: np.ndarray
    total: float


def components(rows: DataFrame, about: dict[int, Centre], most: int) -> dict[int, Components]:
    """The first components for each length of vectors; those without variance are left out."""
    factors: dict[int, list[np.ndarray]] = {dim: [] for dim in about}
    todo = set(about)
    for _ in range(PASSES):

        def part(x: np.ndarray, todo=frozenset(todo), factors=factors) -> np.ndarray | None:
            dim = x.shape[1]
            if dim not in todo:
                return None
            q = about[dim].centred(x)
            for r in factors[dim]:
                q = solved(q, r)
            return q.T @ q

        for dim, gram in folded(rows, part).items():
            if factors[dim] and np.abs(gram - np.eye(dim)).max() < CLOSE or not gram.any():
                todo.discard(dim)
            if gram.any():
                factors[dim].append(upper_factor((gram + gram.T) / 2, about[dim].n, not factors[dim]))
        if not todo:
            break
    out = {}
    for dim, rs in factors.items():
        r = np.zeros((dim, dim))
        for i, one in enumerate(rs):
            r = one @ r if i else one
        _, sigma, turned = np.linalg.svd(r)
        rank = int((sigma > RANK * sigma[0]).sum()) if sigma[0] > 0 else 0
        values = sigma**2 / about[dim].n
        out[dim] = Components(turned[: min(rank, most)].T, values[: min(rank, most)], float(values[:rank].sum()))
    return out


def whitened(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row for each usable row and component.

    A row is usable if its vector isn't null and holds no null or non-finite entry; entries become floor(scale * entry) + offset, held
    within 2^60. Components are those of all usable rows of one length; rows of other lengths are fitted apart, with their own n and
    errors. A component without variance can't be whitened and is left out, so equal rows, a single row, empty vectors and an empty
    table give no rows. Repeated rows and null ids are rows like others. A deviation above 2^63 - 1 reads as that.
    """
    spark = vectors.sparkSession
    rows = written(integer_rows(vectors, id_col, vector_col, scale, offset), shared_dir(spark))
    about = centres(rows)
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = {dim: c for dim, c in components(rows, about, most).items() if len(c.values)} if about else {}
    if not found:
        return spark.createDataFrame([], StructType.fromDDL(columns))

    def projected(x: np.ndarray) -> np.ndarray:
        own = found[x.shape[1]]
        return about[x.shape[1]].centred(x) @ own.vectors / np.sqrt(own.values)

    def part(x: np.ndarray) -> np.ndarray | None:
        if x.shape[1] not in found:
            return None
        w = projected(x)
        return w.T @ w

    errors = {dim: float(np.abs(gram / about[dim].n - np.eye(len(gram))).max()) for dim, gram in folded(rows, part).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in by_length(batches):
            dim = x.shape[1]
            if dim not in found:
                continue
            own, rows_, c = found[dim], len(x), len(found[dim].values)
            at = pa.array(np.repeat(np.arange(rows_), c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * c, about[dim].n, np.int64)), pa.array(about[dim].deviations(x), pa.int64()).take(at),
                    pa.array(projected(x).reshape(-1)), pa.array(np.tile(own.values / own.total, rows_)), pa.array(np.full(rows_ * c, errors[dim])),
                ],
                names=[c.split(" ")[0] for c in columns.split(", ")],
            )

    return rows.mapInArrow(run, columns)


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first 32 components of their covariance, whitened, as ``whitened`` gives them: rows with a null vector or
    null or non-finite entries are left out, other lengths are fitted apart, and an empty table gives no rows."""
    return whitened(table(spark, sf_dir, "embeddings"))
