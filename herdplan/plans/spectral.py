"""Spectra and linear systems of a panel's relationship matrix, without forming it.

G = ZZ'/s shares its non-zero eigenvalues with Z'Z/s. A pass over the rows takes a
block of marker vectors V to Z'(ZV)/s: a partition makes two matrix products and
hands on the sums of its rows, which Spark adds up by place. The driver holds
blocks of marker vectors only, never a matrix of markers by markers or candidates
by candidates; vectors over candidates stay in Spark.

Defined results: an empty panel has no eigenvalues; markers without variance and
equal candidates are directions of eigenvalue zero, which count as rank only above
a share of the largest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RidgeExhausted
from ..shipping import ship

#: Eigenvalues up to this share of the largest are zero.
ZERO = 1e-9
#: Vectors of one pass.
BLOCK = 16
#: Numbers of all partitions together up to which the driver adds them up itself.
GATHERED = 1 << 20


def _dense(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Products:
    """Passes over rows (candidate_id, z array, and b where it is asked for)."""

    def __init__(self, rows: DataFrame, scale: float):
        ship(rows.sparkSession)
        own = [F.col("candidate_id").cast("long").alias("candidate_id"), F.col("z").cast("array<double>").alias("z")]
        if "b" in rows.columns:
            own.append(F.col("b").cast("double").alias("b"))
        self.rows, self.scale, self.passes = rows.select(*own).persist(), float(scale), 0
        zz = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
        got = self.rows.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("m"), F.sum(zz).alias("zz")).first()
        self.parts = self.rows.rdd.getNumPartitions()
        self.n, self.m, self.trace = got["n"], got["m"] or 0, (got["zz"] or 0.0) / self.scale

    def summed(self, of: Callable[[np.ndarray, np.ndarray | None], np.ndarray], columns: int) -> np.ndarray:
        """The sum over partitions' batches of of(z, b), a matrix of markers by
        ``columns``."""
        self.passes += 1
        m, names = self.m, self.rows.columns

        def run(batches):
            total = np.zeros((m, columns))
            for batch in batches:
                if batch.num_rows:
                    total += of(_dense(batch.column("z")), np.asarray(batch.column("b")) if "b" in names else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * columns)), pa.array(total.ravel())], ["place", "v"])

        parts = self.rows.mapInArrow(run, "place long, v double")
        if self.parts * m * columns > GATHERED:
            parts = parts.groupBy("place").agg(F.sum("v").alias("v"))
        got = parts.toArrow()
        return np.bincount(got.column("place").to_numpy(), got.column("v").to_numpy(), m * columns).reshape(m, columns)

    def apply(self, v: np.ndarray) -> np.ndarray:
        """Z'(ZV)/s in one pass."""
        sent = self.rows.sparkSession.sparkContext.broadcast(v)
        try:
            return self.summed(lambda z, _: z.T @ (z @ sent.value), v.shape[1]) / self.scale
        finally:
            sent.destroy()

    def close(self) -> None:
        self.rows.unpersist()


@dataclass
class Ritz:
    """Eigenvalues, falling, their marker vectors, and the norms of A x - value x."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def lanczos(products: Products, wanted: int | None = None, block: int = BLOCK, tol: float = 1e-10, seed: int = 0) -> Ritz:
    """Block Lanczos with full reorthogonalisation: the ``wanted`` leading pairs,
    or all of non-zero value. A space that no pass extends is whole where the
    values add up to the trace; otherwise a new block starts beside it, so equal
    eigenvalues are found however often they occur."""
    rng, m = np.random.default_rng(seed), products.m
    none = Ritz(np.empty(0), np.empty((m, 0)), np.empty(0), 0)
    if not products.n or not m or products.trace <= 0:
        return none
    start_passes = products.passes
    basis, images = np.empty((m, 0)), np.empty((m, 0))

    def beside(w: np.ndarray, least: float) -> np.ndarray:
        """Orthonormal directions of w beyond the basis."""
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        u, size, _ = np.linalg.svd(w, full_matrices=False)
        u = u[:, size > least]
        for _ in range(2):
            u = u - basis @ (basis.T @ u)
            u /= np.maximum(np.linalg.norm(u, axis=0), 1e-300)
        return np.linalg.qr(u)[0] if u.shape[1] else u

    fresh = lambda: products.apply(rng.normal(size=(m, min(block, m))))  # noqa: E731  # in the range of A
    new = beside(fresh(), 0.0)
    while True:
        w = products.apply(new)
        basis, images = np.hstack([basis, new]), np.hstack([images, w])
        t = basis.T @ images
        values, y = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)
        values, y = values[order], y[:, order]
        top = max(float(values[0]), 1e-300)
        residuals = np.linalg.norm(images @ y - (basis @ y) * values, axis=0)
        keep = len(values) if wanted is None else min(wanted, len(values))
        if wanted is not None and len(values) >= wanted and (residuals[:wanted] <= tol * top).all():
            break
        new = beside(w, tol * top) if basis.shape[1] < m else np.empty((m, 0))
        if not new.shape[1]:
            if basis.shape[1] >= min(m, products.n) or products.trace - float(values.sum()) <= tol * products.trace:
                break
            new = beside(fresh(), tol * top)
            if not new.shape[1]:
                break
    sound = np.flatnonzero(values[:keep] > ZERO * top)
    return Ritz(values[sound], basis @ y[:, sound], residuals[sound], products.passes - start_passes)


def spectrum_summary(ritz: Ritz) -> dict:
    """Of all non-zero eigenvalues: their sums of powers, the largest, numerical
    rank, stable rank |G|_F^2 / |G|^2 and participation ratio tr(G)^2 / |G|_F^2."""
    e = ritz.values
    if not len(e):
        return {"trace": 0.0, "squares": 0.0, "fourth": 0.0, "largest": 0.0, "rank": 0, "stable_rank": 0.0, "participation": 0.0}
    squares = float((e**2).sum())
    return {"trace": float(e.sum()), "squares": squares, "fourth": float((e**4).sum()), "largest": float(e[0]), "rank": len(e), "stable_rank": squares / float(e[0]) ** 2, "participation": float(e.sum()) ** 2 / squares}


def extremes(products: Products, ridge: float, block: int = 64) -> tuple[float, float]:
    """(least, greatest) eigenvalue of G + ridge I over the rows: the least is the
    ridge where there are more candidates than independent ones."""
    if not products.n:
        return 0.0, 0.0
    e = lanczos(products, block=block).values
    if not len(e):
        return ridge, ridge
    return ridge + (float(e[-1]) if len(e) >= products.n else 0.0), ridge + float(e[0])


def escalated(products: Products, ridge: float, least: float, most_tries: int, block: int = 64) -> tuple[float, int, float]:
    """(ridge, tries, condition): the ridge grows tenfold until the least eigenvalue
    of G + ridge I is above ``least``; G's own ends are found once, whatever the
    number of tries."""
    low, high = extremes(products, 0.0, block)
    for tries in range(1, most_tries + 1):
        if low + ridge > least:
            return ridge, tries, (high + ridge) / (low + ridge)
        ridge *= 10
    raise RidgeExhausted(f"no ridge up to {ridge / 10:g} is enough")


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, rhs: np.ndarray, tol: float = 1e-13, most: int = 1000) -> np.ndarray:
    """Solves A y = rhs, preconditioned by the diagonal; one product an iteration.
    Ends at a residual of ``tol`` or where rounding lets it fall no further."""
    y, r = np.zeros_like(rhs), rhs.copy()
    size = float(np.linalg.norm(rhs))
    if size == 0:
        return y
    d = r / diagonal
    p, rho = d, float(r @ d)
    best, least, since = y, size, 0
    for _ in range(most):
        q = apply(p)
        step = rho / float(p @ q)
        y, r = y + step * p, r - step * q
        now = float(np.linalg.norm(r))
        best, least, since = (y, now, 0) if now < 0.9 * least else (best, least, since + 1)
        if now <= tol * size or since == 10:
            break
        d = r / diagonal
        before, rho = rho, float(r @ d)
        p = d + (rho / before) * p
    return best


def inverse_times(products: Products, ridge: float, tol: float = 1e-11, refinements: int = 1) -> DataFrame:
    """(candidate_id, b, x) with (ZZ'/s + ridge I) x = b.

    x = (b - Z y) / ridge, where (Z'Z/s + ridge I) y = Z'b/s is a system over
    markers that conjugate gradients solve in a pass an iteration. What the
    division loses, and what a loose ``tol`` leaves, is made good by solving again
    for the residual.
    """
    if ridge <= 0:
        raise ValueError("the ridge must be positive")
    s, spark = products.scale, products.rows.sparkSession

    def state(steps, z, b):
        """x after the steps, and what is left of b."""
        x, r = np.zeros(len(b)), b
        for y, t in steps:
            x = x + (r - z @ y) / ridge
            if t is not None:
                r = b - z @ t / s - ridge * x
        return x, r

    def totals(steps, of):
        sent = spark.sparkContext.broadcast(steps)
        try:
            return products.summed(lambda z, b: (z.T @ of(state(sent.value, z, b)))[:, None], 1)[:, 0]
        finally:
            sent.destroy()

    diagonal = products.summed(lambda z, _: (z * z).sum(axis=0)[:, None], 1)[:, 0] / s + ridge
    shifted = lambda v: products.apply(v[:, None])[:, 0] + ridge * v
    steps: list = []
    for k in range(refinements + 1):
        y = conjugate_gradients(shifted, diagonal, totals(steps, lambda xr: xr[1]) / s, tol)
        steps = [*steps, (y, None)]
        if k < refinements:
            steps[-1] = (y, totals(steps, lambda xr: xr[0]))
    sent = spark.sparkContext.broadcast(steps)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, _ = state(sent.value, _dense(b.column("z")), np.asarray(b.column("b")))
                yield pa.RecordBatch.from_arrays([b.column("candidate_id"), b.column("b"), pa.array(x)], ["candidate_id", "b", "x"])

    return products.rows.mapInArrow(run, "candidate_id long, b double, x double")


def participation(x: DataFrame, column: str) -> DataFrame:
    """One row: (sum v^2)^2 / sum v^4 of the positive part of a column, 0 where
    nothing is positive."""
    v = F.greatest(F.col(column), F.lit(0.0))
    squares = F.sum(v * v)
    return x.agg(F.coalesce(F.when(squares > 0, squares * squares / F.sum(v * v * v * v)), F.lit(0.0)).alias("participation"))
