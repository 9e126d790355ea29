"""Whitening of embeddings: float32 eigenvectors of the covariance, refined by matrix products in higher precision.

Sums. Vectors are whole numbers, so the sums per dimension are exact. Second moments are taken of vectors less the whole
number next to the mean, exactly again: each task adds up one triangle in doubles that stay below 2^53 (Python integers
elsewhere) and Spark adds the tasks' triangles as decimals. The covariance is then one rational number per entry.

Eigenvectors. A symmetric solver in float32 starts; Ogita and Aishima's iteration corrects all vectors at once by matrix
products in extended precision, doubling the right digits each time. The correction of a pair divides by the gap of
its eigenvalues, so inside clusters (gaps below what the step can resolve) it only restores orthogonality; there the
small problem on the cluster's own subspace is solved, shifted by its mean eigenvalue, and its vectors are turned.
The matrices are as wide as a vector, whatever the number of rows.

Defined cases: rows whose vector is null or holds a null take no part; a shorter vector counts as ending in zeros;
a null id stays a null id, repeated rows count each time. Components whose eigenvalue is below 1e-12 of the trace have no
scale and aren't returned; of equal vectors none is left. ``deviation`` is a decimal, as its square can pass a long. An
empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import only, table

COMPONENTS = 32
ROUNDS = 12
_ROWS = 4096
_EXACT = 1 << 53
_W = np.longdouble


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            yield batch.slice(first, _ROWS)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def _gram(x: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of whole numbers, as Python integers."""
    if _most(x) ** 2 * len(x) < _EXACT:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return (
        only(rows, id=id_col, vec=vector_col).where("vec is not null and forall(vec, x -> x is not null)")
        .withColumn("vec", F.col("vec").cast("array<long>"))
    )


def _totals(rows: DataFrame, kernel, cells: int) -> dict[tuple[int, int], object]:
    """Sums by (i, j) of what ``kernel`` gives per batch; at most ``cells`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            part = kernel(batch)
            total = part if total is None else total + part
        if total is not None:
            i, j = (x.ravel() for x in np.triu_indices(total.shape[0], m=total.shape[1])) if total.ndim == 2 else (np.arange(len(total)), np.zeros(len(total), int))
            values = [str(v) for v in (total[i, j] if total.ndim == 2 else total)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], names=["i", "j", "v"])

    parts = rows.mapInArrow(run, "i int, j int, v string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {(r["i"], r["j"]): int(r["v"]) for r in summed.limit(cells + 1).collect()}
    if len(found) > cells:
        raise ValueError("more cells than the vectors' width allows")
    return found


@dataclass(frozen=True)
class Moments:
    n: int
    sums: tuple[int, ...]
    cov: np.ndarray  # extended precision, each entry rounded once


def moments(rows: DataFrame) -> Moments:
    """Count, sums and covariance of (id, vec), with two passes over the vectors."""
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n or not width:
        return Moments(n, (), np.zeros((0, 0), _W))

    def added(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("vec"), width)
        return (x.sum(axis=0) if _most(x) < 1 << 50 else x.astype(object).sum(axis=0)).astype(object)

    found = _totals(rows, added, width)
    sums = [found[i, 0] for i in range(width)]
    shift = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    centre = np.array(shift, dtype=np.int64)
    products = _totals(rows, lambda batch: _gram(_matrix(batch.column("vec"), width) - centre), width * (width + 1) // 2)
    rest = [s - n * c for s, c in zip(sums, shift, strict=True)]
    cov = np.zeros((width, width), _W)
    for (i, j), g in products.items():
        cov[i, j] = cov[j, i] = _rounded(Fraction(n * g - rest[i] * rest[j], n * n))
    return Moments(n, tuple(sums), cov)


def _rounded(x: Fraction) -> _W:
    """A fraction in extended precision: its double and the double of what that leaves."""
    high = float(x)
    return _W(high) + _W(float(x - Fraction(high)))


def _clusters(values: np.ndarray, gap: float) -> Iterator[slice]:
    """Runs of neighbours in falling values that lie closer than ``gap``."""
    cut = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    edge = [0, *cut.tolist(), len(values)]
    yield from (slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1)


def _in_order(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS, depth: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in columns) of the symmetric ``a`` from approximate eigenvectors ``x``.

    ``depth``: how often a cluster may hold narrower ones.
    """
    a, x = a.astype(_W), x.astype(_W)
    eye, scale = np.eye(len(a), dtype=_W), np.abs(a).sum(axis=1).max()
    tiny = np.finfo(_W).eps
    values = np.diag(x.T @ a @ x).copy()
    if not scale:
        return values, x
    before = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by a small gap, would tilt the vectors
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # what this step cannot tell apart
        delta = 2 * (np.linalg.norm(off.astype(float), 2) + scale * np.linalg.norm(r.astype(float), 2))
        delta = max(float(delta), float(scale * tiny * len(a)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        values, x = _in_order(values, x)
        for part in _clusters(values, delta):
            basis, middle = x[:, part], values[part].mean()
            inner = basis.T @ (a @ basis - middle * basis)
            inner = (inner + inner.T) / 2
            size = np.abs(inner).max()
            if depth and size > scale * tiny * len(a):  # else the values are equal and any basis will do
                near = np.linalg.eigh((inner / size).astype(np.float64))[1][:, ::-1]
                x[:, part] = basis @ refine(inner / size, near, rounds, depth - 1)[1]
        step = float(np.abs(off).max() / scale + np.abs(r).max())
        if step <= 4 * len(a) * float(tiny) or (step < 1e-16 and step >= before / 2):
            break
        before = step
    x = x + x @ (eye - x.T @ x) / 2  # orthogonal once more
    return _in_order(np.diag(x.T @ a @ x).copy(), x)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors in columns), extended precision; started in float32."""
    if not len(cov):
        return np.zeros(0, _W), np.zeros((0, 0), _W)
    size = np.abs(cov).max() or _W(1)
    return refine(cov, np.linalg.eigh((cov / size).astype(np.float32))[1][:, ::-1])


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """id, component, n, deviation (decimal), whitened, explained, identity_error for each usable row and component.

    Vector components must be whole numbers. The model is fitted on all usable rows.
    """
    usable = _usable(rows, id_col, vector_col)
    kind = usable.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    m = moments(usable)
    width, n = len(m.sums), m.n
    values, vectors = eigen(m.cov)
    trace = np.trace(m.cov) if width else _W(0)
    kept = int((values[:components] > trace * _W(1e-12)).sum()) if trace else 0
    if not kept:
        return rows.sparkSession.createDataFrame([], schema + ", identity_error double")
    turn = (vectors[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)
    explained = (values[:kept] / trace).astype(np.float64)
    sums = np.array(m.sums, dtype=object)
    centre = np.array([s // n for s in m.sums], dtype=np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in m.sums])

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(batch.column("vec"), width)
        return x, ((x - centre).astype(np.float64) - rest) @ turn

    error = identity_error(usable, lambda batch: projected(batch)[1], n, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, white = projected(batch)
            if n * max(_most(x), 1) < 1 << 62:
                gap = n * x - sums.astype(np.int64)
                wide = _most(gap) ** 2 * width >= 1 << 63
            else:
                gap, wide = n * x.astype(object) - sums, True
            away = ((gap.astype(object) if wide else gap) ** 2).sum(axis=1)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()), pa.array(np.full(rows * kept, n), pa.int64()),
                    pa.array([int(v) for v in away], pa.decimal128(38)).take(pa.array(np.repeat(np.arange(rows), kept))),
                    pa.array(white.ravel()), pa.array(np.tile(explained, rows)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained"],
            )

    return usable.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))


def identity_error(rows: DataFrame, project, n: int, kept: int) -> float:
    """Largest absolute entry of the projections' covariance less the identity, measured on all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((kept, kept)), np.zeros(kept)
        for batch in _slices(batches):
            w = project(batch)
            total += w.T @ w
            sums += w.sum(axis=0)
        i, j = np.indices((kept + 1, kept)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack([total, sums]).ravel())], names=["i", "j", "v"]
        )

    parts = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    grid = np.zeros((kept + 1, kept))
    for r in parts.collect():  # one cell per pair of components
        grid[r["i"], r["j"]] = r["v"]
    mean = grid[kept] / n
    return float(np.abs(grid[:kept] / n - np.outer(mean, mean) - np.eye(kept)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as floor(64 c) + 1000000, whitened to 32 components at most; a deviation past a long is null."""
    x = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(64.0) * c.cast("double")) + 1000000)
    white = whiten(x.where(finite).select("vec_id", whole.alias("embedding")))
    return white.select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened",
        "explained", "identity_error",
    )
