"""Embedding whitening by shifted CholeskyQR.

The centred rows A are too many for one machine, but A'A is not: each pass sums the Gram matrix of the rows
as they are orthogonalised so far, Q = A / R1 / R2 ..., and its Cholesky factor is the next R. The
first passes shift the Gram matrix a little, so that factoring works at any condition number and rank; passes go
on until the Gram matrix is a projection. A = Q R with R = ... R2 R1, and the SVD of R (with the root of the last
Gram matrix in front, which is the identity at full rank) gives the axes and variances of A.

Entries are integers floor(256 c), so sums, distances and centred numerators n x - S are exact.

Defined cases: rows whose vector is null or holds a null or a number that is not finite are left out; shorter vectors are
filled with zeros up to the longest one; repeated vectors count once in the fit and keep all their rows; entries beyond
the range of long are held at its ends, and a deviation beyond it is null; only components of positive variance are
returned, so none for a single vector or an empty table; a null vec_id is kept; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.plans.staging import settle

STEPS = 256  # levels of a unit of an entry
PASSES = 12  # Gram passes, at most
CELLS = 1 << 20  # cells of a block that a task works on
WIDEST = 1 << 63


def entries(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the quantised vector of each row that stays, all of one length."""
    v = F.col(embedding).cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull()).where(~odd)
    whole = kept.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))
    size = whole.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    if size["most"] == size["least"]:
        return whole
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size["most"]) - F.size("x"))
    return whole.withColumn("x", F.concat("x", zeros))


def _blocks(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The rows of a list column as matrices of at most CELLS cells."""
    offsets = column.offsets.to_numpy()
    d = int(offsets[1] - offsets[0]) if len(column) else 0
    flat = column.values.to_numpy()[offsets[0] :][: len(column) * d].reshape(len(column), d)
    for at in range(0, len(column), rows := max(1, CELLS // max(1, d))):
        yield flat[at : at + rows]


def _sums(batches):
    """One row per position and task: rows, and their exact sum."""
    n, total = 0, None
    for b in batches:
        for x in _blocks(b.column(0)):
            n += len(x)
            small = np.abs(x.astype(float)).max(initial=0) * max(1, len(x)) < 2**62
            part = x.sum(0).astype(object) if small else x.astype(object).sum(0)
            total = part if total is None else total + part
    if total is not None:
        at = pa.array(np.arange(len(total)), pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array([n] * len(total), pa.int64()), pa.array([str(s) for s in total])], names=["at", "n", "s"])


@dataclass(frozen=True)
class Axes:
    """What the fit found: n rows, their sums, and the components with positive variance."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    directions: np.ndarray | None = None  # one row per component
    variances: np.ndarray | None = None
    trace: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in long where it fits, else in Python integers."""
        reach = self.n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, self.sums), default=0)
        if reach < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(float) / self.n

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        q = self.centred(x)
        for r in self.factors:
            q = solved(q, r)
        return q

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        return self.centred(x) @ self.directions[:components].T / np.sqrt(self.variances[:components])


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a / r for an upper triangle r, column by column."""
    out = np.empty_like(a)
    for j in range(r.shape[0]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of m'm over all rows, m = of(block). Tasks send the rows of their own sum; the sums of
    equal rows meet in a shuffle, so no task gets more than one row of each other task at a time."""

    def part(batches):
        total = np.zeros((size, size))
        for b in batches:
            for x in _blocks(b.column(0)):
                m = of(x)
                total += m.T @ m
        if size:
            at = np.repeat(np.arange(size, dtype=np.int32), size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(size, dtype=np.int32), size)), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = rows.select("x").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return (out + out.T) / 2


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper R with R'R = gram + shift; the shift grows until rounding no longer stands in the way."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(x: DataFrame, passes: int = PASSES) -> tuple[Axes, DataFrame]:
    """The axes of the distinct vectors of x, and those vectors. The driver holds matrices of dimension
    squared, whatever the number of rows."""
    rows = settle(x.select("x").distinct(), "whitening-fit")
    found = rows.mapInArrow(_sums, "at int, n long, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found.sort(key=lambda r: r["at"])
    d = len(found)
    axes = Axes(found[0]["n"] if d else 0, [int(r["s"]) for r in found])
    if not d:
        return axes, rows
    context, eps = x.sparkSession.sparkContext, np.finfo(float).eps
    factors: list[np.ndarray] = []
    trace, gram = 0.0, np.zeros((d, d))
    for step in range(passes):
        state = context.broadcast(Axes(axes.n, axes.sums, factors))
        gram = _gram(rows, lambda b: state.value.orthogonal(b), d)  # noqa: B023
        if step == 0:
            trace = float(np.trace(gram)) / axes.n
            if trace <= 0:
                return axes, rows
        root = np.linalg.eigvalsh(gram)
        if step and np.minimum(np.abs(root), np.abs(root - 1)).max() < 64 * d * eps:
            break
        # the shift keeps the factor real at any condition; it is at the level of rounding, so it fades as
        # the rows become orthogonal
        norm = float(root[-1])
        shift = 11 * d * (d + 1) * eps * norm if root[0] <= 11 * d * (d + 1) * eps * norm else 0.0
        factors = [*factors, _cholesky(gram, shift)]
    weight, turn = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(weight, 0))[:, None] * turn.T
    for f in reversed(factors):
        r = r @ f
    _, sigma, directions = np.linalg.svd(r)
    real = sigma > max(d, 16) * 16 * eps * sigma[0]
    directions, sigma = directions[real], sigma[real]
    biggest = np.abs(directions).argmax(1)
    directions = directions * np.sign(directions[np.arange(len(directions)), biggest])[:, None]
    return Axes(axes.n, axes.sums, [], directions, sigma**2 / axes.n, trace), rows


def identity_error(axes: Axes, rows: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity, measured on them."""
    k = min(components, len(axes.variances))
    state = rows.sparkSession.sparkContext.broadcast(axes)
    covariance = _gram(rows, lambda b: state.value.whitened(b, k), k) / axes.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector that stays and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = entries(vectors, vec_id, embedding)
    axes, rows = fit(x)
    if axes.variances is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(axes.variances))
    error = identity_error(axes, rows, k)
    state = x.sparkSession.sparkContext.broadcast(axes)

    def project(batches):
        a = state.value
        share = a.variances[:k] / a.trace
        for b in batches:
            start = 0
            for block in _blocks(b.column(1)):
                ids = b.column(0).slice(start, len(block))
                start += len(block)
                num = a.numerators(block)
                reach = np.abs(num.astype(float)).max(initial=0)
                if num.dtype == object or reach**2 * num.shape[1] >= 2**62:
                    exact = [sum(int(v) * int(v) for v in r) for r in num]
                    far = pa.array([e if e < WIDEST else None for e in exact], pa.int64())
                else:
                    far = pa.array((num * num).sum(1), pa.int64())
                w = (num.astype(float) / a.n) @ a.directions[:k].T / np.sqrt(a.variances[:k])
                m, each = len(block), np.repeat(np.arange(len(block)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, a.n)), far.take(pa.array(each)),
                     pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, schema)
