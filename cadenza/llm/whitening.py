"""Whitening of vectors by their principal components, found without forming the covariance matrix.

Block Lanczos on the driver holds a few columns of d numbers; each step is one distributed pass over all rows that
sums Z'(ZQ) of the centred vectors Z for a block Q. The basis is kept orthogonal to itself in full, columns that a
step can't extend are started anew at random (breakdown), a basis that is full is condensed to its best Ritz vectors,
and residuals decide when the wanted pairs are done. The trace, for explained shares, comes from the exact deviations.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that one matrix product takes.
ROWS = 4096
#: Residual of a finished pair, by the largest eigenvalue; eigenvalues below NULL of the largest count as zero.
RESIDUAL, NULL = 1e-13, 1e-12
#: Columns of the basis, by the block, from which it is condensed; passes after which the search gives up.
MOST_BLOCKS, MOST_PASSES = 8, 400
#: Scaled components beyond this are refused, since the exact sums of squares wouldn't fit.
LARGEST = 1 << 31


@dataclass(frozen=True)
class Whitening:
    """n vectors with `sums` by dimension; `axes` (d x components) are unit eigenvectors for `values`, in falling order."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return scaled_deviations(x, self.n, self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    return x * n - sums


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _partial(batches: Iterator[pa.RecordBatch], d: int, of: Callable[[np.ndarray], np.ndarray], kind: type) -> Iterator[pa.RecordBatch]:
    total = None
    for _, x in _matrices(batches, d):
        part = of(x).ravel()
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind)])], ["part"])


def _summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum over all rows of of(block of rows): a task yields one array, arrays are added place by place in a shuffle,
    and as many numbers as the array has come to the driver."""
    name = "long" if kind is np.int64 else "double"
    parts = rows.mapInArrow(functools.partial(_partial, d=d, of=of, kind=kind), f"part array<{name}>")
    total = F.sum(F.col("v").cast("decimal(38,0)")) if kind is np.int64 else F.sum("v")
    got = parts.select(F.posexplode("part").alias("place", "v")).groupBy("place").agg(total.alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["place"])], dtype=object if kind is np.int64 else np.float64)


def _product(x: np.ndarray, n: int, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    z = scaled_deviations(x, n, sums) / n
    return z.T @ (z @ q)


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Upper and lower halves of the deviations' sum, so that neither overflows."""
    dev = deviations(x, n, sums)
    return np.array([(dev >> 32).sum(), (dev & 0xFFFFFFFF).sum()])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """By row, the exact sum of (n * x - sums)**2; OverflowError where it doesn't fit into a long."""
    dev = scaled_deviations(x, n, sums)
    top = max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0))))
    if top * top * dev.shape[1] >= 1 << 63:
        raise OverflowError("deviations beyond 64 bits")
    return (dev * dev).sum(1)


def _orthonormal(w: np.ndarray, basis: np.ndarray, scale: float, draw: np.random.Generator) -> np.ndarray:
    """As many orthonormal columns as w has, or as fit, orthogonal to the basis. Directions that w lacks (breakdown) are
    drawn at random."""
    room = min(w.shape[1], w.shape[0] - basis.shape[1])
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    q = u[:, : min(room, int((s > scale * 1e-12).sum()))]
    while q.shape[1] < room:
        fresh = draw.standard_normal((w.shape[0], room - q.shape[1]))
        known = np.hstack([basis, q])
        for _ in range(3):
            fresh = np.linalg.qr(fresh - known @ (known.T @ fresh))[0]
        q = np.hstack([q, fresh])
    for _ in range(2):  # what rounding left
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    return q


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int, tolerance: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors, of a symmetric operator on d numbers.

    apply(Q) is the operator times a block of columns. A block of at least `wanted` columns finds eigenvalues of every
    multiplicity that matters; a smaller one needs more passes.
    """
    draw = np.random.default_rng(20240611)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q = np.linalg.qr(draw.standard_normal((d, min(block, d))))[0]
    for _ in range(MOST_PASSES):
        got = apply(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, got])
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        scale = float(np.abs(theta).max(initial=0.0))
        k = min(wanted, len(theta))
        residual = np.linalg.norm(image @ s[:, :k] - basis @ s[:, :k] * theta[:k], axis=0)
        if basis.shape[1] == d or (basis.shape[1] > k and len(theta) >= wanted and residual.max(initial=0.0) <= tolerance * scale):
            vectors = basis @ s[:, :k]
            return theta[:k], vectors / np.linalg.norm(vectors, axis=0)
        q = _orthonormal(got, basis, scale, draw)
        if basis.shape[1] >= MOST_BLOCKS * max(block, wanted):  # condense: the best Ritz vectors go on as the basis
            keep = wanted + block
            basis, image = basis @ s[:, :keep], image @ s[:, :keep]
    raise RuntimeError(f"no convergence in {MOST_PASSES} passes")


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, x: array<long>): floor(scale * component) of the rows whose vector is neither null nor empty and holds
    neither nulls nor non-finite entries. A common offset changes neither deviations nor the covariance."""
    v = F.col("v")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & whole).select("vec_id", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def fit(rows: DataFrame, components: int = 32, block: int | None = None) -> Whitening:
    """Fits on all rows of prepared(). Components without variance aren't counted: they can't be whitened.

    Vectors of different lengths or beyond LARGEST raise ValueError. No rows, or rows without variance, give no axes.
    """
    least, most, n, top = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*"), F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    if top >= LARGEST or 2 * n * top >= 1 << 62:
        raise ValueError("components too large for exact sums")
    d = least
    sums = _summed(rows, d, functools.partial(np.sum, axis=0), np.int64).astype(np.int64)
    high, low = _summed(rows, d, functools.partial(_squares, n=n, sums=sums), np.int64)
    trace = float((int(high) << 32) + int(low)) / float(n) ** 3
    wanted = min(components, d)
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    values, axes = block_lanczos(lambda q: _summed(rows, d, functools.partial(_product, n=n, sums=sums, q=q), np.float64).reshape(d, -1) / n, d, wanted, min(block or wanted, d))
    sound = values > NULL * values[0]
    values, axes = values[sound], axes[:, sound]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitening(n, sums, values, axes * signs, trace)


def _second_moment(x: np.ndarray, model: Whitening) -> np.ndarray:
    w = model.whitened(x)
    return np.concatenate([w.sum(0), (w.T @ w).ravel()])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by another pass."""
    k = len(model.values)
    got = _summed(rows, len(model.sums), functools.partial(_second_moment, model=model), np.float64) / model.n
    mean, second = got[:k], got[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k, share = len(model.values), model.values / model.trace
    for b, x in _matrices(batches, len(model.sums)):
        m = b.num_rows
        fill = lambda v, kind: pa.array(np.full(m * k, v), kind)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([
            b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), fill(model.n, pa.int64()),
            pa.array(np.repeat(deviations(x, model.n, model.sums), k)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, m)), fill(error, pa.float64()),
        ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 32, block: int | None = None, scale: float = 64.0) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Usable vectors are those of prepared(); the model is fitted on all of them. Components number as many as the
    vectors' length, at most `components`, less those without variance. Null ids and repeated rows are rows like
    others; equal eigenvalues (ties) give some orthonormal basis of their space. Other columns are ignored, whatever
    their names. Null or unusable vectors give no row, and neither does an empty table or one without variance.
    Vectors of different lengths raise ValueError.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.table(prepared(vectors, id_col, vector_col, scale), "rows")
    model = fit(rows, components, block)
    error = identity_error(rows, model) if len(model.values) else 0.0
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows if len(model.values) else rows.where("false")).mapInArrow(functools.partial(_rows, model=model, error=error), ddl)
