"""Whitening of embeddings from an exact scatter matrix.

Components are made whole numbers.  Their products are summed in residues: each task
multiplies its block by itself modulo several primes, in double-precision products that
never leave the whole numbers that a double holds; Spark adds up the residues, and the
Chinese remainder theorem gives the sums of products and of components exactly.  So the
covariance, centred before a rounding could take place, is right to the last bit of a
double, however far the mean is from zero; its eigenvectors come from ``eigh``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Residues are below this, and so many rows of products of two of them stay below 2**53.
BELOW, BLOCK = 1 << 20, 1 << 13
FITS = float(1 << 62)


def primes(n: int, below: int = BELOW) -> list[int]:
    """The n largest primes under ``below``."""
    out = []
    while len(out) < n:
        below -= 1
        if below < 2:
            raise ValueError("not so many primes")
        if all(below % q for q in range(2, int(below**0.5) + 1)):
            out.append(below)
    return out


def residues_joined(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to zero with these residues (Chinese remainder theorem)."""
    whole, step = 0, 1
    for r, p in zip(residues, moduli):
        whole += step * ((r - whole) * pow(step, -1, p) % p)
        step *= p
    return whole - step if 2 * whole > step else whole


def matrix(column, dim: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of each component, rows filled up with zeros to ``dim`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.floor(scale * out).astype(np.int64) + shift


@dataclass
class Whitening:
    """What the vectors that were fitted have in common: n, exact sums, the exact matrix n^2 * V as its parts, and the components."""

    n: int
    sums: list[int]
    variances: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a column for each
    trace: float
    scale: int
    shift: int

    @property
    def live(self) -> np.ndarray:
        """Components whose variance can be told from zero."""
        return self.variances > len(self.sums) * 2.0**-52 * max(self.variances[0], 0.0) if len(self.variances) else np.zeros(0, bool)

    def off_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they fit, else as Python's whole numbers."""
        near = [s // self.n for s in self.sums]
        rest = np.array([s - m * self.n for s, m in zip(self.sums, near)], object)
        away = x.astype(object) - np.array(near, object) if max(map(abs, near), default=0) >= FITS / 2 else x - np.array(near, np.int64)
        if len(x) and float(np.abs(away).max()) * self.n >= FITS / 2:
            return away.astype(object) * self.n - rest
        return away.astype(np.int64) * self.n - rest.astype(np.int64)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        """Each row on the components, over their deviations; 0 on those without variance."""
        live = self.live
        if off.dtype == object:  # Python's division of whole numbers rounds once
            off = np.array([[int(a) / self.n for a in row] for row in off], float).reshape(off.shape)
        else:
            off = off / self.n
        return off @ self.axes * np.where(live, 1.0, 0.0) / np.sqrt(np.where(live, self.variances, 1.0))


def usable(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) of the rows whose vector has no null, non-finite or (scaled) too large component."""
    c = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).alias("vec_id"), c.alias("v")).where(
        F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a * scale) < FITS)), F.lit(False)))


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Exact sums over all of ``vectors`` (as of ``usable``), and the first components; None if there are none.

    What reaches the driver is a residue for each prime and pair of dimensions, whatever the
    number of vectors.
    """
    n, dim, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: F.greatest(a, F.abs(b))))).first()
    if not n:
        return None
    largest = int(scale * most) + abs(shift) + 2
    moduli, k = [], 4
    while prod(moduli) <= 2 * n * largest**2:
        moduli, k = primes(k), k + 1
    upper = np.triu_indices(dim + 1)

    def scatter(batches):
        total = [np.zeros((dim + 1, dim + 1), np.int64) for _ in moduli]
        for batch in batches:
            x = matrix(batch.column("v"), dim, scale, shift)
            for low in range(0, len(x), BLOCK):
                part = np.hstack([np.ones((len(x[low : low + BLOCK]), 1), np.int64), x[low : low + BLOCK]])
                for i, p in enumerate(moduli):
                    r = (part % p).astype(np.float64)
                    total[i] = (total[i] + (r.T @ r).astype(np.int64)) % p
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), i, np.int32)), pa.array(np.arange(len(upper[0]))), pa.array(t[upper])], names=["prime", "cell", "residue"])

    added = vectors.select("v").mapInArrow(scatter, "prime int, cell long, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue")).toArrow()
    table = np.zeros((len(upper[0]), len(moduli)), np.int64)
    table[added.column("cell").to_numpy(), added.column("prime").to_numpy()] = added.column("residue").to_numpy()
    exact = {}
    for i, j, cell in zip(*(u.tolist() for u in upper), table.tolist()):
        exact[i, j] = residues_joined([r % p for r, p in zip(cell, moduli)], moduli)
    n = exact[0, 0]
    sums = [exact[0, j] for j in range(1, dim + 1)]
    spread = np.zeros((dim, dim))
    trace = 0
    for i in range(dim):
        for j in range(i, dim):
            whole = n * exact[i + 1, j + 1] - sums[i] * sums[j]
            spread[i, j] = spread[j, i] = whole / n**2
            trace += whole if i == j else 0
    values, axes = np.linalg.eigh(spread) if dim else (np.zeros(0), np.zeros((0, 0)))
    k = min(components, dim)
    return Whitening(n, sums, values[::-1][:k].copy(), axes[:, ::-1][:, :k].copy(), trace / n**2, scale, shift)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all of them."""
    k, dim = len(fitted.variances), len(fitted.sums)
    if not k:
        return 0.0
    upper = np.triu_indices(k + 1)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)

    def products(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = shared.value.whitened(shared.value.off_mean(matrix(batch.column("v"), dim, fitted.scale, fitted.shift)))
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "total"])

    got = vectors.select("v").mapInArrow(products, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros(len(upper[0]))
    total[got.column("cell").to_numpy()] = got.column("total").to_numpy()
    square = np.zeros((k + 1, k + 1))
    square[upper] = total
    # the vectors are centred already; what rounding left of their mean goes, too
    mean = square[0, 1:] / fitted.n
    covariance = square[1:, 1:] / fitted.n - np.triu(np.outer(mean, mean))
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each component c becomes floor(scale * c) + shift.  Rows whose vector is null or holds a
    null or non-finite component (or one that, scaled, fits no long) take no part; vectors of
    unequal length are filled up with zeros.  Repeated rows and ids each count.  deviation is
    a decimal, exact, of all dimensions (null beyond 38 digits).  Components are numbered from
    1 by falling variance; equal variances leave their axes open, as eigenvectors do.  On a
    component without variance every vector is 0, and identity_error is 1 then.  A table
    without usable vectors gives no rows.  Other columns play no part, whatever their names.
    """
    kinds = T.StructType([T.StructField("vec_id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                          T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
                          T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    vectors = usable(rows, id_col, vector_col, scale)
    fitted = fit(vectors, components, scale, shift)
    if fitted is None or not len(fitted.variances):
        return rows.sparkSession.createDataFrame([], kinds)
    error = identity_error(vectors, fitted)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    k, dim = len(fitted.variances), len(fitted.sums)
    share = np.maximum(fitted.variances, 0.0) / fitted.trace if fitted.trace else np.zeros(k)

    def projected(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                off = shared.value.off_mean(matrix(part.column("v"), dim, fitted.scale, fitted.shift))
                if off.dtype == object or float(np.abs(off).max(initial=0)) >= (FITS / dim) ** 0.5:
                    squares = [sum(int(a) ** 2 for a in row) for row in off.tolist()]
                    squares = pa.array([s if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                else:
                    squares = pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(each), fitted.n)),
                    squares.take(each), pa.array(shared.value.whitened(off).ravel()), pa.array(np.tile(share, part.num_rows)), pa.array(np.full(len(each), error)),
                ], names=kinds.names)

    return vectors.mapInArrow(projected, kinds)


def whitened_long(rows: DataFrame) -> DataFrame:
    """``whiten`` of embeddings, with deviation as a long (null where it doesn't fit one)."""
    return whiten(rows).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
