"""Whitening of embeddings by a cyclic Jacobi eigensolver.

The distinct vectors are written once; one pass over them gives exact sums, a
second the scatter matrix, centred before it is multiplied, as partial matrices
whose entries Spark adds up by their place. The driver then holds one matrix of
the size of a vector by itself and turns it by Jacobi rotations: a sweep meets
every pair of dimensions once, in rounds of disjoint pairs, so that a round is a
few numpy operations; it ends when every off-diagonal entry has vanished against
its two diagonal ones, which is what keeps small eigenvalues accurate. Components
are sorted, their matrix is broadcast, and a map-only pass whitens all rows. A
third pass over the distinct vectors measures the covariance of what came out.

Defined results: vectors that are null, empty, or hold null or non-finite entries
or entries of 2^46 or more take no part and give no row; vectors of each length
are whitened among themselves; repeated rows are whitened each but fitted once;
null ids are kept; directions without variance (eigenvalues up to 1e-12 of the
largest) are no components, so a table of equal vectors, or an empty one, gives
no rows; ``deviation`` is null where it does not fit a long. Other columns that
are not asked for do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, frugal, materialised, prepare, table

#: Whole steps of one unit, what is added so that entries are positive, components.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond have no exact whole step.
LARGEST = float(1 << 46)
#: Eigenvalues up to this share of the largest are no direction.
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """A fit over distinct vectors of one length: number, sums by dimension,
    components in columns by falling eigenvalue, and how far the covariance of the
    whitened vectors is from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact, or None beyond a long."""
        about = (((x - self.mean) * float(self.n)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):  # wrapped numbers are exact where the result fits
            d = x * np.int64(self.n) - np.array([s % (1 << 64) for s in self.sums], np.uint64).astype(np.int64)
            exact = (d * d).sum(axis=1).tolist()
        return [v if a < 9.2e18 else None for v, a in zip(exact, about.tolist())]


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    return F.coalesce(sound & (F.size(vector) > 0), F.lit(False))


def quantised(vector: Column) -> Column:
    """Whole steps of 1/64, moved to be positive."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + F.lit(SHIFT).cast("long"))


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of a symmetric matrix, falling."""
    a, n = np.array(a, float), len(a)
    v, eps = np.eye(n), np.finfo(float).eps
    seats = np.arange(n + n % 2)  # a tournament: every pair of dimensions meets once a sweep
    for _ in range(sweeps):
        turned = 0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = np.sort(np.stack([seats[:half], seats[::-1][:half]]), axis=0)
            p, q = p[q < n], q[q < n]
            off, low, high = a[p, q], a[p, p], a[q, q]
            act = np.abs(off) > eps * np.sqrt(np.abs(low * high))
            if act.any():
                turned += int(act.sum())
                p, q, off, low, high = p[act], q[act], off[act], low[act], high[act]
                with np.errstate(over="ignore"):
                    slope = (high - low) / (2 * off)
                    t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.sqrt(slope * slope + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                rows = a[p], a[q]
                a[p], a[q] = c[:, None] * rows[0] - s[:, None] * rows[1], s[:, None] * rows[0] + c[:, None] * rows[1]
                for m in (a, v):
                    columns = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * columns[0] - s * columns[1], s * columns[0] + c * columns[1]
                a[p, q] = a[q, p] = 0.0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)


def _matrices(batch: pa.RecordBatch, name: str):
    """(rows, matrix) of each length of vectors in a batch."""
    column = batch.column(name)
    widths = np.asarray(pc.list_value_length(column))
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        yield w, own, np.asarray(column.take(pa.array(own)).flatten()).reshape(len(own), w)


def _second_moments(distinct: DataFrame, of, size) -> dict[int, np.ndarray]:
    """For each length the sum over vectors of y y', where y = of(length, x) has
    ``size(length)`` entries: a partition hands on one triangle, whose entries
    Spark adds up by place."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for w, _, x in _matrices(b, "x"):
                y = of(w, x)
                held[w] = held.get(w, 0.0) + y.T @ y
        for w, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), w, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["w", "i", "j", "v"])

    got = distinct.mapInArrow(frugal(run), "w int, i int, j int, v double").groupBy("w", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    w, i, j, v = (got.column(c).to_numpy() for c in ("w", "i", "j", "v"))
    for width in np.unique(w).tolist():
        own, m = w == width, np.zeros((size(width),) * 2)
        m[i[own], j[own]] = m[j[own], i[own]] = v[own]
        out[width] = m
    return out


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and their exact sums."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for w, own, x in _matrices(b, "x"):
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                n, a, c = held.get(w, (0, 0, 0))
                held[w] = (n + len(own), a + low, c + high)
        for w, (n, low, high) in held.items():
            at = pa.array(np.arange(w, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w, np.int32)), at, pa.array(np.full(w, n, np.int64)), pa.array(low), pa.array(high)], ["w", "j", "n", "low", "high"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = distinct.mapInArrow(frugal(run), "w int, j int, n long, low long, high long").groupBy("w", "j").agg(whole("n"), whole("low"), whole("high")).orderBy("w", "j").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["w"], (int(r["n"]), []))[1].append(int(r["low"]) + (int(r["high"]) << 32))
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of the distinct vectors of column ``x``
    (array of whole numbers)."""
    prepare(vectors.sparkSession)
    distinct = materialised(vectors.select("x").distinct())
    try:
        sums = _sums(distinct)
        means = {w: np.array([s / n for s in total]) for w, (n, total) in sums.items()}
        scatter = _second_moments(distinct, lambda w, x: x - means[w], lambda w: w)
        out = {}
        for w, (n, total) in sums.items():
            v = scatter[w] / n
            e, basis = jacobi(v)
            keep = min(components, int((e > NO_VARIANCE * max(e[0], 0.0)).sum()))
            if keep:
                out[w] = Whitening(n, total, basis[:, :keep], e[:keep], float(np.trace(v)))
        # lengths without variance have no components and nothing to measure
        wide = distinct.where(F.size("x").isin(list(out))) if out else distinct.limit(0)
        for w, m in _second_moments(wide, lambda w, x: out[w].whiten(x), lambda w: len(out[w].values)).items():
            out[w].identity_error = float(np.abs(m / out[w].n - np.eye(len(m))).max())
        return out
    finally:
        discard(distinct)


def whitened(rows: DataFrame, models: dict[int, Whitening], key: str) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for
    each row and component; map-only."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(models)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for w, own, x in _matrices(b, "x"):
                model = sent.value.get(w)
                if model is None:
                    continue
                y, k = model.whiten(x), len(model.values)
                rows, many = np.repeat(own, k), len(own) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(key).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(many, model.n, np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))), pa.array(y.ravel()),
                        pa.array(np.tile(model.values / model.trace, len(own))), pa.array(np.full(many, model.identity_error)),
                    ], names,
                )

    return rows.select(key, "x").mapInArrow(frugal(run), f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors and whiten every row that has one."""
    rows = vectors.where(usable(F.col(vector))).select(key, quantised(F.col(vector)).alias("x"))
    return whitened(rows, fit(rows, components), key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over all of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
