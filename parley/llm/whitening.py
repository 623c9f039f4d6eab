"""Embedding whitening by merged moments.

A vector's entries become integers, ``floor(scale * c) + offset``.  The fit list holds
each distinct integer vector once.  Every partition of it works out its count, sums,
mean and centred scatter; two such states merge by the pairwise formula of Chan, Golub
and LeVeque, in a tree of tasks, and only one state of dim * dim numbers reaches the
driver, where the eigenvectors are found.  A second pass over the fit list whitens it and
merges the moments of the result the same way: their distance from the identity is
returned as ``identity_error``.

Counts and sums are exact integers.  States are held relative to ``offset``, so that
means keep their digits.

Vectors that are null, or hold null or non-finite entries, take no part; nor do those of
another length than the longest one (an empty vector only where all are empty, and it has
no components).  Entries whose integer would pass 2**40 in size raise, as do deviations
beyond 64 bits.  Rows that repeat each get their rows, whatever their id, null included.  A
component without variance (as with fewer distinct vectors than dimensions) has a null
``whitened`` and takes no part in ``identity_error``; with no variance at all ``explained``
is null too.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_rows, stored

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 40
#: An eigenvalue below this share of the greatest one counts as zero.
RANK = 1e-12
#: Levels of the tree in which states merge.
DEPTH = 3

#: Count, sums relative to the offset, mean, centred scatter.
State = tuple[int, list[int], np.ndarray, np.ndarray]


def usable(vector: Column) -> Column:
    """Is a vector there, with numbers that are all finite?"""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def fixed(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The integers of a usable vector."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    small = F.forall(scaled, lambda c: (c < LARGEST) & (c > -LARGEST))
    return F.when(small, F.transform(scaled, lambda c: c + F.lit(offset))).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")).cast("array<bigint>"))


def moments(rows: np.ndarray) -> State:
    """The state of some rows; sums are exact where the rows are integers."""
    exact = rows.dtype.kind == "i"
    sums = rows.sum(axis=0)
    mean = sums / len(rows)
    apart = rows - mean
    return len(rows), [int(s) for s in sums] if exact else [], mean, apart.T @ apart


def merge(a: State, b: State) -> State:
    """The state of two sets of rows from their states."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n = a[0] + b[0]
    step = b[2] - a[2]
    mean = a[2] + step * (b[0] / n)
    return n, [x + y for x, y in zip(a[1], b[1])], mean, a[3] + b[3] + np.outer(step, step) * (a[0] * b[0] / n)


NOTHING: State = (0, [], np.zeros(0), np.zeros((0, 0)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of lists that all have ``dim`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def merged(points: DataFrame, change, dim: int) -> State:
    """The state of all rows of the column ``x`` after ``change``, a function of a batch's matrix; one state a partition, merged in a tree."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NOTHING
        for batch in batches:
            if batch.num_rows:
                state = merge(state, moments(change(matrix(batch.column(0), dim))))
        if state[0]:
            n, sums, mean, scatter = state
            columns = [[n], [[str(s) for s in sums]], [mean.tobytes()], [scatter.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()))], names=["n", "sums", "mean", "scatter"])

    def state(row) -> State:
        mean = np.frombuffer(bytes(row["mean"]))
        return row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(bytes(row["scatter"])).reshape(len(mean), len(mean))

    rows = points.select("x").mapInArrow(partition, "n bigint, sums array<string>, mean binary, scatter binary").rdd.map(state)
    # a state of nothing, since a tree can't reduce no rows at all
    return rows.union(points.sparkSession.sparkContext.parallelize([NOTHING], 1)).treeReduce(merge, DEPTH)


@dataclass
class Model:
    """What whitening needs: count, exact sums, unit components in columns by falling eigenvalue, eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows, NaN in components without variance."""
        apart = self.from_mean(x).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, apart @ self.components / np.sqrt(self.values), np.nan)

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: in Python's integers where 64 bits might not do."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n * x - sums) ** 2``, exact."""
        apart = self.from_mean(x)
        if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * max(1, apart.shape[1]) < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
        found = [int(d) for d in (apart.astype(object) ** 2).sum(axis=1)]
        if max(found) >= 1 << 63:
            raise OverflowError("a deviation doesn't fit 64 bits")
        return found


def fit(points: DataFrame, dim: int, components: int, offset: int = OFFSET) -> Model:
    """The model of a table with the distinct vectors ``x``, checked by a second pass."""
    n, low, _, scatter = merged(points, lambda x: x - offset, dim)
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(scatter) / n)
    values = np.where(values > RANK * max(values[0], 0.0), values, 0.0)
    model = Model(n, [s + n * offset for s in low], vectors[:, :components], values[:components], trace)
    real = model.values > 0
    if real.any():
        seen = merged(points, lambda x: model.project(x)[:, real], dim)
        model.identity_error = float(np.abs(seen[3] / seen[0] - np.eye(int(real.sum()))).max())
    return model


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable row with each of the first components."""
    vector = F.col(vector_col)
    mine = rows.filter(usable(vector)).select(F.col(id_col).alias(id_col), fixed(vector, scale, offset).alias("x"))
    points = stored(mine.select("x").distinct())
    dim = points.agg(F.max(F.size("x"))).first()[0] or 0
    found = mine.filter(F.size("x") == dim)
    if dim:
        model = fit(points.filter(F.size("x") == dim), dim, components, offset)
        found = arrow_rows(found, lambda batch: [model.deviations(x := matrix(batch.column(1), dim)), model.project(x).tolist()], "deviation bigint, whitened array<double>", 1)
        explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    else:  # no vector, or only empty ones: no components
        model, explained = Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0), [0.0]
        found = found.filter("false").select(id_col, F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    each = found.select(id_col, "deviation", F.posexplode("whitened").alias("_at", "w"))
    share = F.get(F.array(*(F.lit(e).cast("double") for e in explained)), F.col("_at"))
    return each.select(
        id_col,
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        share.alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
