"""Embedding whitening by matrix-free block Lanczos.

Vectors become whole numbers (256 to a unit), and each distinct one counts once in the fit list. Its covariance V is
never formed: a pass over the fit list gives V times a block of vectors, each task centring its rows before it
multiplies, and partial products are summed by dimension. Block Lanczos builds an orthonormal basis with full
reorthogonalisation against all earlier vectors (twice). A block that loses rank is filled up with new random vectors
(a restart), so repeated eigenvalues and eigenvectors that the start misses are found too. Ritz pairs of the projected
matrix are accepted when the residuals |V u - e u| of the first ones are below ``TOLERANCE`` of the largest, or when the
basis spans the whole space. The trace comes from the rows' exact deviations, so shares need no full spectrum.

Only numbers of the dimension's size reach the driver: sums, blocks of ``dim`` x ``BLOCK``, and the basis.

Defined results: a null vector, or one with null or non-finite entries, gives no row; so does a vector of another length
than most have (the longest of equally frequent lengths), and an empty one; entries beyond the range of longs are held
at its ends; repeated rows and null ids are kept; components of no variance (below 1e-13 of the trace) are left out, so
a table of one distinct vector gives no row; ``deviation`` is null where it passes 63 bits; other columns are ignored,
whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import stored, tidy

SCALE = 256
BLOCK = 8
#: A residual that ends the iteration, as a share of the largest eigenvalue; the least variance of a component, as a share of the trace.
TOLERANCE, NO_VARIANCE = 1e-13, 1e-13


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their vectors as whole numbers."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    use = np.flatnonzero(n == dim)
    flat = lists.take(pa.array(use)).flatten()
    x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    scaled = np.floor(x[fine] * SCALE)
    limit = float(2**63 - 1024)
    return use[fine], np.clip(scaled, -limit, limit).astype(np.int64)


def common_length(rows: DataFrame, vec_col: str) -> int:
    """The length that most vectors have; 0 for a table without any."""
    found = rows.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return found["dim"] if found else 0


def _packed(rows: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``x``: each vector's whole numbers as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole_vectors(batch.column(0), dim)
            yield pa.record_batch([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    return rows.select(vec_col).mapInArrow(tidy(task), "x binary")


def _summed(fit: DataFrame, dim: int, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` (some rows as whole numbers to a matrix of ``shape``) over the fit list: summed in tasks, then by row of the matrix."""
    height, width = shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + part(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, dim)), True
        if any_:
            yield pa.record_batch([pa.array(np.arange(height), pa.int64()), *(pa.array(total[:, j]) for j in range(width))], names=["i", *(f"c{j}" for j in range(width))])

    sums = fit.mapInArrow(tidy(task), "i long, " + ", ".join(f"c{j} double" for j in range(width)))
    out = np.zeros(shape)
    for r in sums.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect():
        out[r["i"]] = [r[f"c{j}"] for j in range(width)]
    return out


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, dim)
                n += len(x)
                high += (x >> 32).sum(axis=0)  # two halves: neither sum passes 63 bits
                low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(dim), pa.int64()), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    wide = "decimal(38,0)"
    sums = fit.mapInArrow(tidy(task), "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "low")])
    rows = {r["i"]: r for r in sums.collect()}
    if not rows:
        return 0, [0] * dim
    return rows[0]["n"], [(int(rows[i]["high"]) << 32) + int(rows[i]["low"]) for i in range(dim)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)^2 of each row, exact."""
    if not len(x):
        return []
    bound = max(n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums), 1)
    if bound * bound * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles; the whole part of the mean is taken off in whole numbers."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - base).astype(np.float64) - rest


@dataclass
class Fit:
    """What whitening needs: vectors' number and sums, the trace, eigenvalues and components (one a column), passes made."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def _orthonormal(w: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """``w``'s columns made orthonormal to ``basis`` and one another; those that break down are replaced by new random ones while there is room."""
    dim, out = w.shape[0], basis
    for column in w.T:
        v, size = column, 0.0
        for attempt in range(8):
            norm = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > 1e-10 * (norm if attempt else max(norm, scale)):
                break
            if out.shape[1] >= dim:
                return out[:, basis.shape[1] :]
            v = rng.standard_normal(dim)
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
        if out.shape[1] >= dim:
            break
    return out[:, basis.shape[1] :]


def block_lanczos(times, dim: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues and unit eigenvectors of the symmetric matrix behind ``times`` (block to block), and the passes made."""
    rng = np.random.default_rng(seed)
    basis = np.zeros((dim, 0))
    image = np.zeros((dim, 0))
    new = _orthonormal(rng.standard_normal((dim, min(block, dim))), basis, rng, 0.0)
    passes = 0
    while True:
        w = times(new)
        passes += 1
        basis, image = np.column_stack([basis, new]), np.column_stack([image, w])
        h = basis.T @ image
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        vectors = basis @ s
        top = max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(image @ s - vectors * values, axis=0).max()
        if basis.shape[1] >= dim or (len(values) >= k and residual <= tolerance * top):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        # the full recurrence: what is left of the image after all earlier blocks
        new = _orthonormal(w - basis @ (basis.T @ w), basis, rng, float(np.linalg.norm(w, axis=0).max()))


def fit(packed: DataFrame, dim: int, components: int = 4, block: int = BLOCK) -> Fit:
    """The components of the distinct vectors of ``packed`` (x: see :func:`_packed`)."""
    n, sums = exact_sums(packed, dim)
    if not n:
        return Fit(0, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), 0)

    trace = float(_summed(packed, dim, lambda x: np.array([[float(sum(deviations(x, n, sums)))]]), (1, 1))[0, 0]) / float(n) ** 3

    def times(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ v)

        return _summed(packed, dim, part, v.shape) / n

    values, vectors, passes = block_lanczos(times, dim, min(components, dim), max(block, components))
    keep = values > NO_VARIANCE * trace
    return Fit(n, sums, trace, values[keep], vectors[:, keep], passes)


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(x, fit.n, fit.sums) @ (fit.vectors / np.sqrt(fit.values))


def identity_error(packed: DataFrame, dim: int, fit: Fit) -> float:
    """The largest entry of the whitened fit list's covariance, less the identity."""
    k = len(fit.values)
    if not k:
        return 0.0
    mean = _summed(packed, dim, lambda x: _whitened(x, fit).sum(axis=0)[None, :], (1, k))[0] / fit.n

    def part(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, fit) - mean
        return w.T @ w

    return float(np.abs(_summed(packed, dim, part, (k, k)) / fit.n - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector and component: ``id_col``, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = common_length(rows, vec_col)
    if not dim:
        return rows.sparkSession.createDataFrame([], schema)
    packed = stored(_packed(rows, vec_col, dim).distinct(), "vectors")
    found = fit(packed, dim, components, block)
    error = identity_error(packed, dim, found)
    shares, k = found.values / found.trace if len(found.values) else np.zeros(0), len(found.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, x = whole_vectors(batch.column(1), dim)
            m = len(x)
            own = [d if d < 1 << 63 else None for d in deviations(x, found.n, found.sums)]
            columns = [
                batch.column(0).take(pa.array(np.repeat(use, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, found.n), pa.int64()), pa.array(own, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(_whitened(x, found).ravel(), pa.float64()), pa.array(np.tile(shares, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(id_col, vec_col).mapInArrow(tidy(task), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def brute_force(rows: list[tuple[int, list | None]], components: int = 4) -> tuple[dict[tuple, tuple], np.ndarray]:
    """(id, component) to (n, deviation, |whitened|, explained), with the covariance formed whole; and all eigenvalues: for tests."""
    import math
    from fractions import Fraction

    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit_list = sorted({x for _, x in xs})
    n = len(fit_list)
    sums = [sum(c) for c in zip(*fit_list, strict=True)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)] for x in fit_list])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in xs:
        c = np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)])
        dev = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        for k in range(min(components, len(values))):
            if values[k] > NO_VARIANCE * values.sum():
                out[(i, k + 1)] = (n, dev, abs(float(c @ vectors[:, k]) / math.sqrt(values[k])), values[k] / values.sum())
    return out, values
