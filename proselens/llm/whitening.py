"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never formed: a staged table holds the whole-number rows in blocks, and each product centres its block
first. From a start vector v1 the method alternates u = Xv and Xᵀu, each orthogonalised against all vectors of its side,
until the singular triplets asked for have converged or the space is exhausted; the small bidiagonal matrix that has
collected the lengths is decomposed on the driver and gives components (its right vectors, turned back by the v) and
deviations (its singular values).

A left vector is as long as the table has rows, so it is never collected. Every u is a combination of the centred rows' columns,
X times a vector as short as a row, and the driver keeps that short one: an executor that is lost costs only its blocks of one
product. A step is one job: a block's share of Xv, its products with the earlier u, from which the new u follows, and Xᵀ times
it; a task gives one row of two numbers a dimension. Where orthogonalising took much of u's length, the job is run once more.

Rows: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than
most rows have (the longer of two lengths as frequent). Entries beyond 2**40 count as that. Repeated rows count as often as they stand. No usable rows give no rows
of result. Only components with an eigenvalue above rounding are given (a table of equal rows has none); of equal eigenvalues
any orthonormal choice of vectors is right. ``deviation`` is null where it is beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Components given; bytes and rows of a block at most; what share of the largest singular value a triplet's residual may be.
COMPONENTS, BLOCK_BYTES, BLOCK_ROWS, TOLERANCE = 8, 2 << 20, 4096, 1e-15
SCALE, SHIFT = 1024, 100_000
#: Tasks whose parts the driver adds up by itself.
FEW_TASKS = 512
#: Largest whole number that a row holds, so that a block's sums stay in 64 bits; a length that counts as none, beside the largest.
_MOST, _NOTHING, _WIDE = 1 << 50, 1e-13, 1 << 62


@dataclass(frozen=True)
class Fit:
    """n rows with the sums of their dimensions; components by falling eigenvalue; the covariance's trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-number rows as blocks of 64-bit integers, with the sums and the sums of squares of each dimension."""

    def block(ids: list, rows: list) -> pa.RecordBatch:
        x = np.concatenate(rows)
        sums = pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary()), sums], names=["ids", "x", "sums"])

    ids, rows = [], []
    for batch in batches:
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * len(batch.column("x")[0])))) if batch.num_rows else 1
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            flat = part.column("x").flatten().to_numpy()
            rows.append(flat.reshape(part.num_rows, -1))
            ids += part.column("vec_id").to_pylist()
            if len(ids) * rows[-1].shape[1] * 8 >= BLOCK_BYTES:
                yield block(ids, rows)
                ids, rows = [], []
    if ids:
        yield block(ids, rows)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    length = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    rows = rows.where(F.size("embedding") == (length.length if length else 0))
    whole = lambda c: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("long") + SHIFT
    return rows.select("vec_id", F.transform("embedding", whole).alias("x"))


class Blocks:
    """The staged blocks of a table of rows, and products with its centred rows."""

    def __init__(self, rows: DataFrame):
        made = rows.mapInArrow(_blocks, "ids array<long>, x binary, sums array<long>")
        self.table = stage(made, "blocks")
        totals = self.table.select(F.size("ids").alias("n"), F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
        self.n, self.sums = (int(totals[0].n) if totals else 0), [int(t.s) for t in totals]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.empty(0)
        self.dim = len(self.sums)
        self.tasks = self.table.rdd.getNumPartitions()

    def total(self, work, width: int) -> np.ndarray:
        """The sum over blocks of ``work(centred block)``, an array of ``width`` numbers. A task gives one row."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for raw in batch.column("x"):
                    total += work(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, len(mean)) - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for raw in batch.column("part"):
                    total += np.frombuffer(raw.as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = self.table.select("x").mapInArrow(run, "part binary")
        if self.tasks > FEW_TASKS:  # many parts are added up by tasks first
            parts = parts.repartition(FEW_TASKS // 8).mapInArrow(add, "part binary")
        return sum((np.frombuffer(r.part, np.float64) for r in parts.collect()), np.zeros(width))

    def products(self, c: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """For w = X c: its products with X times each column of ``earlier``, its squared length, and Xᵀw."""
        n, dim = earlier.shape[1], self.dim

        def work(x: np.ndarray) -> np.ndarray:
            w = x @ c
            # (X C)ᵀ w and not Cᵀ Xᵀ w, which would lose digits where the rows are near a subspace
            return np.concatenate(((x @ earlier).T @ w, np.zeros(dim - n), [w @ w], w @ x))

        found = self.total(work, 2 * self.dim + 1)  # of one width, so that Spark compiles one plan
        return found[:n], float(found[self.dim]), found[self.dim + 1 :]


def bidiagonalise(blocks: Blocks, want: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of the centred rows, ``want`` at most, largest first.

    Left vectors are kept as short vectors c, u = X c. When a length vanishes, the side starts anew with a vector orthogonal to
    all before, as repeated values need.
    """
    d = blocks.dim
    draw = np.random.default_rng(11)

    def fresh(basis: list[np.ndarray]) -> np.ndarray | None:
        for _ in range(5):
            v = _orthogonal(draw.standard_normal(d), basis)
            size = np.linalg.norm(v)
            if size > 1e-8:
                return _orthogonal(v / size, basis) / np.linalg.norm(_orthogonal(v / size, basis))
        return None

    right, short, images, alphas, betas = [], [], [], [], []
    v, beta, scale = fresh([]), 0.0, 0.0
    while v is not None and len(right) < d:
        c = v - (beta * short[-1] if short else 0.0)
        earlier = np.array(short).T.reshape(d, len(short))
        # u = X v, made orthogonal to the earlier ones, and Xᵀu; once more where much of its length was lost
        while True:
            inner, square, z = blocks.products(c, earlier)
            scale = max(scale, np.sqrt(square))
            left = square - float(inner @ inner)
            c, z = c - earlier @ inner, z - np.array(images).T.reshape(d, len(short)) @ inner
            if left > square / 2 or left <= (_NOTHING * scale) ** 2:
                break
        alpha = np.sqrt(max(left, 0.0))
        right.append(v)
        if alpha <= _NOTHING * scale:  # X v lies in what the left vectors span: a null direction has no left vector
            alpha, c, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            c, z = c / alpha, z / alpha
        alphas.append(alpha)
        short.append(c)
        images.append(z)
        w = _orthogonal(_orthogonal(z, right), right)
        beta = float(np.linalg.norm(w))
        if len(right) == d:
            break
        if beta <= _NOTHING * scale:
            beta, v = 0.0, fresh(right)
        else:
            v = w / beta
        betas.append(beta)
        if len(right) >= want and beta:
            left_small, values, _ = np.linalg.svd(_bidiagonal(alphas, betas[:-1]))
            if (beta * np.abs(left_small[-1, :want]) <= tolerance * values[0]).all():
                break
    if not right:
        return np.zeros((d, 0)), np.zeros(0)
    _, values, turned = np.linalg.svd(_bidiagonal(alphas, betas[: len(alphas) - 1]))
    return np.array(right).T @ turned[:want].T, values[:want]


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas, 1)


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for b in basis:
        v = v - (b @ v) * b
    return v


def fit(blocks: Blocks, components: int = COMPONENTS) -> Fit:
    """Components of the covariance with divisor n."""
    if not blocks.n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    vectors, values = bidiagonalise(blocks, min(components, blocks.dim))
    trace = float(blocks.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / blocks.n
    eigenvalues = values**2 / blocks.n
    some = eigenvalues > max(trace, 1e-300) * 1e-24
    if trace <= 0:
        some[:] = False
    return Fit(blocks.n, blocks.sums, eigenvalues[some], vectors[:, some] / np.linalg.norm(vectors[:, some], axis=0), trace)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exactly: in Python's whole numbers only where 64 bits might not hold it."""
    widest = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True)), default=0)
    if widest * widest * len(sums) < _WIDE and n * int(np.abs(x).max(initial=0)) < _WIDE:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    blocks = Blocks(usable(vectors))
    found = fit(blocks, components)
    k = len(found.eigenvalues)
    mean, turn = blocks.mean, found.vectors / np.sqrt(found.eigenvalues)
    # of the whitened rows: their means and products, for the covariance as it came out
    moments = blocks.total(lambda x: np.append((y := x @ turn).sum(0), (y.T @ y).ravel()), k + k * k) if k else np.zeros(0)
    middle = moments[:k] / max(found.n, 1)
    error = float(np.abs(moments[k:].reshape(k, k) / max(found.n, 1) - np.outer(middle, middle) - np.eye(k)).max(initial=0.0))
    explained = found.eigenvalues / found.trace if k else found.eigenvalues
    n, sums = found.n, found.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("x"), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, len(mean))
                own = ids.values
                yield pa.RecordBatch.from_arrays(
                    [
                        own.take(pa.array(np.repeat(np.arange(len(own)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                        pa.array(np.full(k * len(own), n, np.int64)),
                        pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))),
                        pa.array(((x - mean) @ turn).ravel()),
                        pa.array(np.tile(explained, len(own))),
                        pa.array(np.full(k * len(own), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.table.select("ids", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
