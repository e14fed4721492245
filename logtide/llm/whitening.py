"""Embedding whitening by one-sided Jacobi SVD of a blockwise TSQR.

Entries become whole numbers, so counts, sums and deviations are exact and the centre is subtracted before
anything is rounded.  Each task turns its centred rows, a block at a time, into one triangular R (QR of the last R
above the next block); the tasks' R are stacked and reduced in a tree, so what reaches the driver is one
square of the dimension.  Plane rotations make R's columns orthogonal: the rotations' product holds the
components, the columns' norms the standard deviations, without ever forming a covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, SHIFT = 64, 1_000_000
_LIMIT = float(1 << 52)
_FAN_IN = 16


def whole_numbers(rows: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of each entry, those beyond 2**52 cut to it."""
    return np.clip(np.floor(SCALE * rows.astype(np.float64)), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def _usable(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of vectors that are there and hold finite entries alone, and these."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    end = np.cumsum(size)
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size]))
    return at, column.take(pa.array(at))


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``dim`` entries and their whole numbers."""
    at = np.flatnonzero(np.array(vectors.value_lengths()) == dim)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return at, whole_numbers(flat.reshape(-1, dim))


def _packed(rows: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, as narrow as the row's largest distance from the shift allows."""
    d = rows - SHIFT
    most = np.maximum(d, ~d).max(axis=1, initial=0)
    out: list = [None] * len(rows)
    for bits in (8, 16, 32, 64):
        lower = 0 if bits == 8 else 1 << (bits // 2 - 1)
        for i in np.flatnonzero((most >= lower) & ((most < 1 << (bits - 1)) if bits < 64 else True)):
            out[i] = d[i].astype(f"<i{bits // 8}").tobytes()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, most: int = 4096) -> Iterator[np.ndarray]:
    """Whole numbers of packed rows, at most ``most`` at a time and of one width."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            rows = b.column("x").slice(at, most).to_pylist()
            for width in sorted({len(x) for x in rows}):
                data = b"".join(x for x in rows if len(x) == width)
                yield np.frombuffer(data, f"<i{width // dim}").reshape(-1, dim).astype(np.int64) + SHIFT


def jacobi(r: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi SVD of a square: standard deviations (falling) and components (columns).

    Columns meet in rounds of disjoint pairs; each pair is turned until it is orthogonal to double precision.
    """
    u, n = np.array(r, np.float64), r.shape[1]
    v = np.eye(n)
    order = np.arange(n + n % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            a, b = order[: len(order) // 2], order[::-1][: len(order) // 2]
            real = (a < n) & (b < n)
            a, b = a[real], b[real]
            x, y = u[:, a], u[:, b]
            p, q, s = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            apart = np.abs(s) > tolerance * np.sqrt(p * q)
            worst = max(worst, float(np.max(np.abs(s[apart]) / np.sqrt(p * q)[apart], initial=0.0)))
            zeta = np.where(apart, (q - p) / np.where(apart, 2 * s, 1.0), 0.0)
            t = np.where(apart, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            for m in (u, v):
                x, y = m[:, a], m[:, b]
                m[:, a], m[:, b] = c * x - c * t * y, c * t * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if worst == 0.0:
            break
    sigma = np.sqrt((u * u).sum(0))
    falling = np.argsort(-sigma, kind="stable")
    return sigma[falling], v[:, falling]


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with ``sums``; ``deviation`` (falling) and ``axes`` (columns) of the kept components,
    ``explained`` shares of all variance, ``error`` of the whitened covariance."""

    n: int
    sums: np.ndarray
    deviation: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once: n * x - S is whole."""
        return _scaled(x, self.sums, self.n).astype(np.float64) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.axes) / self.deviation

    def distance(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)**2, exact; None where they pass 64 bits."""
        d = _scaled(x, self.sums, self.n)
        if d.dtype != object and len(d) and float(np.abs(d).max()) ** 2 * self.dim < 2.0**62:
            return (d * d).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(e) ** 2 for e in row) for row in d)]


def _scaled(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n * x - S as int64, or as Python's integers where that could overflow."""
    most = max(float(np.abs(x).max(initial=0)) * n, max((abs(float(s)) for s in sums), default=0.0))
    if most < 2.0**61:
        return n * x - np.array([int(s) for s in sums], np.int64)
    return n * x.astype(object) - np.array([int(s) for s in sums], object)


def _triangle(rows: np.ndarray, r: np.ndarray | None) -> np.ndarray:
    """R of the last R above more rows; at most square."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _reduced(parts: DataFrame, dim: int) -> np.ndarray:
    """One R of all tasks' ``task, r``, ``_FAN_IN`` at a time."""

    def stacked(table):
        r = None
        for x in table.column("r"):
            r = _triangle(np.frombuffer(x.as_py(), np.float64).reshape(-1, dim), r)
        return pa.table([table.column("task")[:1], pa.array([r.tobytes()], pa.binary())], names=["task", "r"])

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        parts = parts.withColumn("task", F.expr(f"task div {_FAN_IN}").cast("int")).groupBy("task").applyInArrow(stacked, "task int, r binary")
        tasks = -(-tasks // _FAN_IN)
    last = parts.first()
    r = np.zeros((dim, dim))
    if last:
        top = np.frombuffer(bytes(last.r), np.float64).reshape(-1, dim)
        r[: len(top)] = top
    return r


def fit(vectors: DataFrame, components: int = 16, block_rows: int = 4096) -> Whitening | None:
    """Whitening of the distinct usable vectors of ``embedding``; None if there are none.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another
    length than most usable rows have (of equally frequent lengths the longest) and empty ones.
    Components without variance, up to rounding, are left out too: there may be fewer than asked for.
    """
    vectors = vectors.select("embedding")

    def lengths(batches):
        for b in batches:
            size, n = np.unique(np.array(_usable(b.column("embedding"))[1].value_lengths(), np.int64), return_counts=True)
            yield pa.record_batch([pa.array(size), pa.array(n)], ["dim", "n"])

    usual = vectors.mapInArrow(lengths, "dim long, n long").where("dim > 0").groupBy("dim").agg(F.sum("n").alias("n"))
    usual = usual.orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return None
    dim = usual.dim

    def packed(batches):
        for b in batches:
            _, x = _matrix(_usable(b.column("embedding"))[1], dim)
            yield pa.record_batch([pa.array(_packed(np.unique(x, axis=0)) if len(x) else [], pa.binary())], ["x"])

    listed = materialise(vectors.mapInArrow(packed, "x binary").distinct(), "vectors")

    def summed(batches):
        n, total = 0, np.zeros(dim, object)
        for x in _blocks(batches, dim, block_rows):
            n, total = n + len(x), total + np.array([int(s) for s in x.sum(axis=0)] if np.abs(x).max() < 2**49 else x.astype(object).sum(axis=0), object)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(s) for s in total]], pa.list_(pa.string()))], ["n", "sums"])

    each = listed.mapInArrow(summed, "n long, sums array<string>").where("n > 0")
    sums = each.select("n", F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28, 0)")).cast("string").alias("s"))
    sums = sorted(sums.collect(), key=lambda r: r.d)  # a row a dimension
    n, total = sums[0].n, np.array([int(r.s) for r in sums], object)
    raw = Whitening(n, total, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))

    def triangles(batches):
        from pyspark import TaskContext

        r = None
        for x in _blocks(batches, dim, block_rows):
            r = _triangle(raw.centred(x), r)
        if r is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    sigma, axes = jacobi(_reduced(listed.mapInArrow(triangles, "task int, r binary"), dim) / np.sqrt(n))
    kept = min(components, int((sigma > dim * np.finfo(float).eps * sigma[0]).sum()))
    found = Whitening(n, total, sigma[:kept], axes[:, :kept], (sigma**2)[:kept] / max((sigma**2).sum(), np.finfo(float).tiny))

    def moments(batches):
        first, second = np.zeros(kept), np.zeros((kept, kept))
        for x in _blocks(batches, dim, block_rows):
            w = found.whiten(x)
            first, second = first + w.sum(axis=0), second + w.T @ w
        flat = np.concatenate([first, second.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "s"])

    if not kept:
        return found
    flat = np.zeros(kept + kept * kept)
    for r in listed.mapInArrow(moments, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # kept squared numbers
        flat[r.i] = r.s / n
    covariance = flat[kept:].reshape(kept, kept) - np.outer(flat[:kept], flat[:kept])
    return Whitening(n, total, found.deviation, found.axes, found.explained, float(np.abs(covariance - np.eye(kept)).max()))


def apply(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id`` and per row ``n, deviation, whitened`` (an array), for the rows that ``fit`` would use.

    ``deviation`` is null where it passes 64 bits.  Repeated rows and null vec_ids each get their row.
    """
    schema = "vec_id long, n long, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            at, good = _usable(b.column("embedding"))
            own, x = _matrix(good, model.dim)
            ids = b.column("vec_id").take(pa.array(at[own]))
            w = pa.array(list(model.whiten(x)), pa.list_(pa.float64()))
            yield pa.record_batch([ids, pa.array([model.n] * len(x), pa.int64()), pa.array(model.distance(x), pa.int64()), w], ["vec_id", "n", "deviation", "whitened"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    What counts as usable ``fit`` says; a table without usable rows, or one whose usable rows are all equal, gives no rows.
    """
    model = fit(vectors, components)
    each = apply(vectors, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.array(*(F.lit(float(x)) for x in model.explained)) if model and len(model.explained) else F.array().cast("array<double>")
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(model.error if model else 0.0).alias("identity_error"))
