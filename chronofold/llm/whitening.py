"""Whitening of vectors by hierarchical merging of singular value decompositions.

Every partition of the distinct vectors keeps the number, the exact sums, and
all singular values and right vectors of its centred rows.  Two such states are
merged by decomposing the rows of both, scaled by their singular values, and one
more row that corrects for the difference of the means.  No dimension is left
out, so a merged state says of the covariance all that its rows do.  States are
merged some at a time, level by level, each level written.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written

#: States that are merged by one task, and rows that are decomposed together.
FAN_IN, ROWS = 16, 4096
_STATE = "node long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"
_LONG = 1 << 63


class State:
    """Number, sums (exact), singular values and right vectors of centred rows of whole numbers."""

    def __init__(self, n: int, sums: list[int], singular: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.singular, self.vectors = n, sums, singular, vectors

    @classmethod
    def of_rows(cls, x: np.ndarray) -> State:
        sums = exact_sums(x)
        centred = centre(x, len(x), sums)
        _, s, v = np.linalg.svd(centred, full_matrices=False)
        return cls(len(x), sums, s, v)

    def merge(self, other: State) -> State:
        """All rows of both."""
        a, b = self.n, other.n
        apart = np.array([float((p * b - q * a) / Decimal(a) / Decimal(b)) for p, q in zip(map(Decimal, self.sums), map(Decimal, other.sums), strict=True)])
        rows = np.concatenate([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, np.sqrt(a / (a + b) * b) * apart[None]])
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return State(a + b, [p + q for p, q in zip(self.sums, other.sums, strict=True)], s, v)

    def row(self, node: int) -> list:
        return [node, self.n, [Decimal(v) for v in self.sums], self.singular.tolist(), self.vectors.ravel().tolist()]

    @classmethod
    def from_row(cls, n, sums, singular, vectors) -> State:
        return cls(n, [int(v) for v in sums], np.array(singular), np.array(vectors, float).reshape(len(singular), -1))


def _table(rows: list[list]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(_STATE.split(", "), kinds, strict=True))})


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns of 64-bit whole numbers, whatever their size."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(0), low.sum(0), strict=True)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit numbers where these hold it, else as Python's."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    if most < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once or twice."""
    d = _scaled(x, n, sums)
    return (d / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums over the dimensions of (n * x - sums)^2, exactly; null beyond 38 digits."""
    d = _scaled(x, n, sums)
    if d.dtype != object and x.size and int(np.abs(d).max()) ** 2 * x.shape[1] < _LONG:
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    d = d.astype(object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (d * d).sum(1).tolist()], pa.decimal128(38, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def merged(partials: DataFrame, name: str = "whitening") -> DataFrame:
    """One row: the state of all rows of states, numbered by node from 0; FAN_IN of them meet in a task."""

    def merge(key, table):
        rows = table.sort_by("node").to_pylist()
        found = State.from_row(*(rows[0][c] for c in ("n", "sums", "singular", "vectors")))
        for r in rows[1:]:
            found = found.merge(State.from_row(*(r[c] for c in ("n", "sums", "singular", "vectors"))))
        return _table([found.row(key[0].as_py())])

    level = written(partials, name)
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        above = written(level.groupBy(F.floor(F.col("node") / FAN_IN).alias("above")).applyInArrow(merge, _STATE), name)
        forget(level)
        level = above
    return level


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Each vector on the first components of its table's covariance, with variance 1.

    Entries become whole numbers floor(scale * c), at most those of 64 bits; the
    fit list is each distinct vector of these once.  Returns for each row and
    component (numbered from 1 by falling eigenvalue): vec_id, component, n
    (vectors fitted), deviation (exact sum of (n * x - sums)^2, decimal),
    whitened, explained (the component's share of the trace), identity_error
    (largest absolute entry of the returned components' covariance over the fit
    list, minus the identity).  A component's largest entry is positive, the
    first of equal ones; components of equal eigenvalues have no order of their
    own.

    Null vectors, empty ones and those with null or non-finite entries take no
    part, nor do lengths other than the most frequent (the longest of these).
    Components without variance, to double precision, are left out, so a table
    of equal vectors gives no rows.  Repeated rows and null ids are kept, other
    columns ignored.  The driver holds the final state alone, the square of the
    dimension.
    """
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.transform(v, lambda c: F.floor(c.cast("double") * scale))).alias("x")).where("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if common is None:
        return empty
    dims = common[0]
    rows = rows.where(F.size("x") == dims)
    fit = written(rows.select("x").distinct(), "distinct")

    def partial(batches):
        found = None
        for b in batches:
            x = _matrix(b.column(0), dims)
            for at in range(0, len(x), ROWS):
                some = State.of_rows(x[at : at + ROWS])
                found = some if found is None else found.merge(some)
        if found is not None:
            yield from _table([found.row(TaskContext.get().partitionId())]).to_batches()

    top = merged(fit.mapInArrow(partial, _STATE))
    state = State.from_row(*top.select("n", "sums", "singular", "vectors").first())
    forget(top)
    n, sums, s = state.n, state.sums, state.singular
    real = np.flatnonzero(s > (s[0] if len(s) else 0.0) * max(n, dims) ** 0.5 * np.finfo(float).eps * 8)[:components]
    if not len(real):
        forget(fit)
        return empty
    basis = state.vectors[real]
    basis = basis * np.sign(basis[np.arange(len(real)), np.abs(basis).argmax(1)])[:, None]
    eigen = s[real] ** 2 / n
    explained = s[real] ** 2 / (s**2).sum()
    project = (basis / np.sqrt(eigen)[:, None]).T

    def moments(batches):
        total = np.zeros((len(real), len(real)))
        for b in batches:
            w = centre(_matrix(b.column(0), dims), n, sums) @ project
            total += w.T @ w
        i, j = np.divmod(np.arange(total.size), len(real))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    # the centred vectors' mean is 0, so these products are covariances
    products = fit.mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    error = max(abs(r.v / n - (r.i == r.j)) for r in products)
    forget(fit)

    def apply(batches):
        k = len(real)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = _matrix(part.column(1), dims)
                w, each = centre(x, n, sums) @ project, np.repeat(np.arange(len(x)), k)
                deviation = deviations(x, n, sums).take(pa.array(each))
                number = np.tile(np.arange(k), len(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(number + 1, pa.int32()), pa.array(np.full(len(each), n)), deviation, pa.array(w.ravel()), pa.array(explained[number]), pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, empty.schema)
