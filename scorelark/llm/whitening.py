"""Embedding whitening by matrix-free block Lanczos (operator 11).

Vectors are scaled to whole numbers, x = floor(SCALE c) + SHIFT, so that counts, sums and deviations from the mean are
exact.  The covariance of n vectors of d dimensions is never formed:

1. ``moments``: n and the sums S by dimension, as two halves of 32 bits, in one aggregation.
2. ``fit``: block Lanczos.  A step multiplies a block of d x b numbers by the centred covariance in one distributed pass,
   Xc' (Xc B) / n with Xc = (n x - S) / n centred exactly before it is multiplied; a task returns d rows of b sums.  The product
   is orthogonalised twice against the whole basis; directions that vanish (a breakdown) are restarted with random
   ones, and the basis may grow until it spans all dimensions.  Ritz values and vectors come from the basis and its stored products;
   the loop ends when the residuals of all wanted pairs are below TOLERANCE of the largest eigenvalue, or when the
   basis is complete.  A block is wider than the number of components, so eigenvalues that repeat are found as often
   as they occur.  The first pass also sums the deviations, which give the trace.
3. ``whiten``: one pass sums the whitened vectors' own covariance, another returns a row for each vector and component.

What comes to the driver has d rows, whatever n is: the basis, its products and the sums.

Defined results: a row whose vector is null, empty or holds null, NaN, infinite entries or entries beyond 2^56 (no long x exists)
is dropped; all vectors of a fit have one length, the most frequent one (of ties the larger), and rows of other lengths
are dropped too; repeated rows count each, and a null vec_id is kept as it is; components whose eigenvalue is below RANK of the largest
don't exist (they can't have variance 1), so one single vector, or equal ones, give no rows; an empty table gives an empty
result; a deviation beyond 2^63 - 1 is null; other columns are ignored, and vec_id keeps its type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import textkit as tk

SCALE, SHIFT, COMPONENTS, EXTRA = 64, 1_000_000, 32, 8
TOLERANCE, RANK, CELLS = 1e-13, 1e-11, 1 << 20
_MOST = 2**63 - 1


def whole_numbers(column: pa.Array, scale: int = SCALE, shift: int = SHIFT):
    """(rows of the column, matrix of their x) of the valid vectors, for each length that occurs, in parts of about CELLS entries."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < 2.0**56))])
    valid = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]])
    for d in np.unique(size[valid]).tolist():
        rows = np.flatnonzero(valid & (size == d))
        step = max(1, CELLS // d)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, np.floor(scale * values[begin[part][:, None] + np.arange(d)]).astype(np.int64) + shift


def moments(df: DataFrame, vector: str, scale: int, shift: int) -> tuple[int, np.ndarray]:
    """(n, S as whole numbers without bound) of the valid vectors of the most frequent length."""

    def run(batches):
        total: dict = {}
        for batch in tk.steady(batches):
            for rows, x in whole_numbers(batch.column(0), scale, shift):
                own = total.setdefault(x.shape[1], np.zeros((3, x.shape[1]), np.int64))
                own += [np.full(x.shape[1], len(rows)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(n), pa.array(high), pa.array(low)], names=["d", "i", "n", "high", "low"])

    found = df.select(vector).mapInArrow(run, "d long, i long, n long, high long, low long").groupBy("d", "i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    most = found.agg(F.max(F.struct("n", "d"))["d"].alias("most"))
    rows = found.join(F.broadcast(most), F.col("d") == F.col("most")).select("i", "n", "high", "low").collect()  # one for each dimension
    sums = np.array([r.high * 2**32 + r.low for r in sorted(rows)], object)
    return (rows[0].n if rows else 0), sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: longs where they fit, else Python's whole numbers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums.tolist()), default=0))
    return n * x - sums.astype(np.int64) if most < 2**62 else n * x.astype(object) - sums


def deviations(z: np.ndarray) -> np.ndarray:
    """Sum of the squares of each row of whole numbers, exact."""
    if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] > _MOST:
        z = z.astype(object)
    return (z * z).sum(1)


def _sums(df: DataFrame, width: int, fn) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all batches of ``fn(batch) -> (matrix of ``width`` columns, one more number)``; a row of the matrix is a row of the aggregation."""

    def run(batches):
        total, extra = None, 0.0
        for batch in tk.steady(batches):
            matrix, more = fn(batch)
            if matrix is not None:
                total, extra = (matrix if total is None else total + matrix), extra + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64())), pa.array(np.full(len(total), extra))], names=["i", "v", "more"])

    found = df.mapInArrow(run, "i int, v array<double>, more double").groupBy("i").agg(F.sum("more").alias("more"), *(F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)))
    rows = sorted(found.collect(), key=lambda r: r.i)
    return np.array([[r[f"v{k}"] for k in range(width)] for r in rows]).reshape(-1, width), np.array([r.more for r in rows])


@dataclass
class Model:
    """What a fit found; ``components`` has a column for each component."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int = 0
    restarts: int = 0
    residual: float = 0.0
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else self.eigenvalues

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows of exact deviations n x - S."""
        return (z.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.eigenvalues))


def orthogonal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal basis of what ``block`` has outside ``basis``; directions shorter than ``least`` are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    for _ in range(2):  # directions near ``least`` have lost digits
        u, _ = np.linalg.qr(u - basis @ (basis.T @ u)) if u.shape[1] else (u, None)
    return u


def lanczos(multiply, d: int, k: int, extra: int = EXTRA, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int, int, float]:
    """(eigenvalues, eigenvectors, passes, restarts, largest residual) of the k largest pairs of the symmetric ``multiply``."""
    rng = np.random.default_rng(seed)
    width = min(d, k + extra)
    fresh = orthogonal(rng.standard_normal((d, width)), np.zeros((d, 0)), 0.0)
    basis, image, passes, restarts, history = np.zeros((d, 0)), np.zeros((d, 0)), 0, 0, []
    while True:
        product = multiply(fresh)
        basis, image, passes = np.hstack([basis, fresh]), np.hstack([image, product]), passes + 1
        small = basis.T @ image
        value, inner = np.linalg.eigh((small + small.T) / 2)
        value, inner = value[::-1], inner[:, ::-1]
        top = min(k, len(value))
        vectors = basis @ inner[:, :top]
        residual = np.linalg.norm(image @ inner[:, :top] - vectors * value[:top], axis=0).max(initial=0)
        size = max(abs(value).max(initial=0), np.finfo(float).tiny)
        history.append(residual / size)
        # rounding may keep residuals just above the tolerance: then two more passes don't make them smaller
        stuck = len(history) > 3 and history[-1] < 1e-10 and min(history[-2:]) > 0.5 * min(history[:-2])
        if basis.shape[1] == d or (basis.shape[1] >= k and history[-1] <= tolerance) or stuck:
            return value[:top], vectors, passes, restarts, history[-1]
        fresh = orthogonal(product, basis, 1e-13 * size * np.sqrt(d))
        room = min(width, d - basis.shape[1])
        fresh = fresh[:, :room]
        if fresh.shape[1] < room:  # breakdown
            restarts += 1
            fresh = np.hstack([fresh, orthogonal(rng.standard_normal((d, room - fresh.shape[1])), np.hstack([basis, fresh]), 0.0)])


def fit(spark: SparkSession, df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Model:
    n, sums = moments(df, vector, scale, shift)
    d, trace = len(sums), []
    if not n:
        return Model(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0, scale=scale, shift=shift)
    vectors = df.select(vector)

    def multiply(block: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(block)  # d x b numbers

        def part(batch):
            total, deviation = None, 0.0
            for _, x in whole_numbers(batch.column(0), scale, shift):
                if x.shape[1] == d:
                    y = centred(x, n, sums).astype(np.float64) / n
                    own = y.T @ (y @ held.value)
                    total, deviation = (own if total is None else total + own), deviation + float((y * y).sum())
            return total, deviation

        product, squares = _sums(vectors, block.shape[1], part)
        trace.append(squares[0] / n)
        held.unpersist()
        return product / n

    value, vector_, passes, restarts, residual = lanczos(multiply, d, min(components, d))
    real = value > RANK * value.max(initial=0)
    return Model(n, sums, vector_[:, real], value[real], trace[0], passes, restarts, float(residual), scale, shift)


def identity_error(df: DataFrame, vector: str, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, d = len(model.eigenvalues), len(model.sums)

    def part(batch):
        total, rows = None, 0.0
        for own, x in whole_numbers(batch.column(0), model.scale, model.shift):
            if x.shape[1] == d:
                w = model.project(centred(x, model.n, model.sums))
                own_sum = np.vstack([w.T @ w, w.sum(0)])
                total, rows = (own_sum if total is None else total + own_sum), rows + len(own)
        return total, rows

    if not k:
        return 0.0
    found, _ = _sums(df.select(vector), k, part)
    mean = found[-1] / model.n
    return float(np.abs(found[:-1] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(spark: SparkSession, df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per vector and component: key, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    model = fit(spark, df, vector, components, scale, shift)
    error, k, d, n = identity_error(df, vector, model), len(model.eigenvalues), len(model.sums), model.n
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"]

    def run(batches):
        for batch in tk.steady(batches):
            for rows, x in whole_numbers(batch.column(1), scale, shift):
                if x.shape[1] != d or not k:
                    continue
                z = centred(x, n, model.sums)
                off, w, step = deviations(z), model.project(z), max(1, (1 << 16) // k)
                for lo in range(0, len(rows), step):
                    m = len(rows[lo : lo + step])
                    per = lambda a: np.tile(a, m)
                    deviation = pa.array([int(v) if v <= _MOST else None for v in off[lo : lo + step]], pa.int64())
                    at = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[lo : lo + step])).take(at), pa.array(per(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(m * k, n)), deviation.take(at), pa.array(w[lo : lo + step].ravel()), pa.array(per(model.explained)), pa.array(np.full(m * k, error)), pa.array(per(model.eigenvalues))],
                        names=[key, *names],
                    )

    selected = df.select(key, vector)
    kinds = [IntegerType(), LongType(), LongType(), *[DoubleType()] * 4]
    return selected.mapInArrow(run, StructType([selected.schema[key], *(StructField(c, t) for c, t in zip(names, kinds, strict=True))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("eigenvalue")


#: SQL has no eigenvectors; the exact columns it has.
DEVIATION_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) + {SHIFT}) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
m AS (SELECT count(*) AS n FROM v),
s AS (SELECT i, sum(c) AS s FROM (SELECT unnest(x) AS c, unnest(range(len(x))) AS i FROM v) GROUP BY i)
SELECT vec_id, n, CAST(sum((n * c - s) * (n * c - s)) AS BIGINT) AS deviation FROM (SELECT vec_id, unnest(x) AS c, unnest(range(len(x))) AS i FROM v) JOIN s USING (i), m GROUP BY ALL"""
