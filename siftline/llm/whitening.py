"""Whitening of vectors by a tall and skinny QR factorisation (TSQR).

Rows of whole numbers are centred with their exact sums, every task reduces its rows to the triangular factor R of a QR
factorisation, and factors are merged in a tree until one is left.  The singular vectors of the last R are the components;
its singular values are the square roots of the covariance's eigenvalues times n.  The covariance itself is never formed, so
small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.support import Scratch

#: Steps of the grid to which numbers are rounded down, and what is added so that they are positive.
GRID, OFFSET = 64, 1_000_000
#: Components given out at most; R factors merged at once; vectors of a step inside a task.
COMPONENTS, FAN_IN, AT_ONCE = 16, 8, 4096
#: Components whose deviation is below this share of the largest have no direction of their own.
RANK = 1e-12


def on_grid(vector: Column, grid: int = GRID, offset: int = OFFSET) -> Column:
    """floor(grid * c) + offset of every number c, as longs; null where the vector or a number in it is null or not finite.
    Numbers beyond the range of longs stop at its ends, as casts do."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * grid) + F.lit(offset).cast("long"))
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(finite, whole)


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    n = len(column)
    return np.asarray(column.flatten(), np.int64).reshape(n, -1) if n else np.empty((0, 0), np.int64)


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors with exact sums; components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they fit, else Python's integers."""
        sums = np.array(self.sums, object)
        top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if top < 1 << 62:
            return x * np.int64(self.n) - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        d = self.deviations(x)
        return (d / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared deviations, exact; null where a long can't hold one."""
        d = self.deviations(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (d * d).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]


def _sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are, and their exact sums: a row for each task and dimension goes to a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                n += len(x)
                # Halves of 32 bits, so that no sum of a batch can overflow.
                some = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                sums = some if sums is None else [a + b for a, b in zip(sums, some)]
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, len(sums)), pa.int32()), "total": pa.array(list(map(str, [n, *sums])))})

    totals = vectors.mapInArrow(run, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["place"]: int(r["total"]) for r in totals.collect()}  # a row for each dimension
    return found.pop(-1, 0), tuple(found[k] for k in sorted(found))


def _reduced(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, x]), mode="r")


def _factor(vectors: DataFrame, centre: Whitening, scratch: Scratch) -> np.ndarray:
    """R of all centred vectors: one for each task, then a tree of merges."""
    width = len(centre.sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                r = _reduced(r, centre.centred(_rows(batch.column(0).slice(k, AT_ONCE))))
        if len(r):
            yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        r = np.empty((0, width))
        for some in sorted(zip(table.column("id").to_pylist(), table.column("r").to_pylist())):
            r = _reduced(r, np.frombuffer(some[1]).reshape(-1, width))
        return pa.table({"id": pa.array([table.column("to")[0].as_py()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    schema = "id int, r binary"
    factors = scratch.write(vectors.mapInArrow(local, schema), "factors")
    while (left := factors.count()) > 1:
        most = factors.agg(F.max("id")).first()[0]
        # Numbers are dealt anew where many tasks had no rows, so that every round leaves an eighth.
        step = max(FAN_IN, (most + 1) * FAN_IN // left)
        factors = scratch.write(factors.withColumn("to", F.floor(F.col("id") / step).cast("int")).groupBy("to").applyInArrow(merged, schema), "factors")
    row = factors.first()
    return np.frombuffer(bytes(row["r"])).reshape(-1, width) if row else np.empty((0, width))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table with one column of long vectors of one length; every row counts once.

    Components are numbered by falling eigenvalue and have their largest entry positive.  Directions without variance are
    not components; a table of fewer than two different vectors has none.
    """
    scratch = Scratch(vectors.sparkSession)
    n, sums = _sums(vectors)
    none = Whitening(n, sums, np.empty((len(sums), 0)), np.empty(0), 0.0)
    if n == 0 or not sums:
        return none
    _, s, v = np.linalg.svd(_factor(vectors, none, scratch), full_matrices=False)
    kept = s[:components] > RANK * (s[0] if len(s) else 0)
    v, e = v[:components][kept].T, s[:components][kept] ** 2 / n
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, v, e, float((s * s).sum() / n))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_rows(batch.column(0)))
                cells += w.T @ w
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k * k), pa.int32()), "total": pa.array(cells.ravel())})

    if not k:
        return 0.0
    totals = vectors.mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    covariance = np.zeros(k * k)
    for r in totals.collect():  # a row for each pair of components
        covariance[r["cell"]] = r["total"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(identifier, component, n, deviation, whitened, explained, identity_error) of every row and component.

    The vectors are put on a grid; each distinct one is fitted once, however many rows have it.  Rows are left out whose
    vector is null or empty, holds null or a number that is not finite, or has another length than most (ties: the longest),
    which no projection fits.  Repeated rows and null identifiers stay.  Without rows, or with fewer than two different
    vectors, nothing has variance and no row comes out; of directions without variance there are no rows either.  Other
    columns are not read.  deviation is null where a long can't hold it.
    """
    scratch = Scratch(rows.sparkSession)
    kind = rows.schema[identifier].dataType.simpleString()
    x = rows.select(F.col(identifier).alias("id"), on_grid(F.col(vector)).alias("x")).where(F.size("x") > 0)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        x = x.where(F.size("x") == lengths["d"])
    distinct = scratch.write(x.select("x").distinct(), "vectors")
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    k = len(model.eigenvalues)
    schema = f"{identifier} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                v = _rows(some.column(1))
                each = np.repeat(np.arange(len(v)), k)
                columns = [
                    some.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(model.squares(v), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(v).ravel()),
                    pa.array(np.tile(model.eigenvalues / model.trace, len(v))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[identifier, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
