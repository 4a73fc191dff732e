"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.support import Scratch, parts_of

#: Links that a task holds before it flattens them.
HELD_LINKS = 500_000


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges at hand: (node, least node) without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    own = root == np.arange(len(nodes))
    return nodes[~own], nodes[root[~own]]


class Links:
    """Links that a task gathers; what it holds is flattened to stars, and given out if that is still too much."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self.held.append((u, v))
        self.n += len(u)
        if self.n <= HELD_LINKS:
            return []
        flat = self.flat()
        if self.n > HELD_LINKS // 2:
            self.held, self.n = [], 0
            return [flat]
        return []

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        u, v = forest(*(np.concatenate([x[k] for x in self.held]) for k in range(2)))
        self.held, self.n = [(u, v)], len(u)
        return u, v


def _flattened(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges' components, with fewer edges and shorter paths: each task makes stars of its share."""
    kind = edges.schema["u"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(c.tolist() if kind == "binary" else c, arrow) for c in x], names=["u", "v"])
        for batch in batches:
            u, v = (np.array(batch.column(k).to_pylist(), object) if kind == "binary" else batch.column(k).to_numpy() for k in range(2))
            yield from map(out, links.add(u, v))
        yield out(links.flat())

    return edges.repartition(tasks).mapInArrow(run, edges.schema)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, root) for every node of edges (u, v), longs or binaries; root is the least node of its component and has a
    row as well.

    Self loops and repeated edges are welcome.  A round joins edges with a row per node; a hub's edges are spread by
    Spark's handling of skewed joins.  Each round is written, so a lost executor costs one round at most; the number of
    rounds grows with the logarithm of the longest path.  scratch takes the tables written.
    """
    written = (scratch or Scratch(edges.sparkSession)).write
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    e = written(_flattened(e, max(1, parts_of(edges.sparkSession) // 16)), "edges")
    if e.count() <= HELD_LINKS:  # no more than any task holds: one more share ends it
        e = written(_flattened(e, 1), "edges")
    else:
        e = written(e.distinct(), "edges")
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where(F.col("v") > F.col("u")).join(_mins(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small = large.join(_mins(large), "u")
        e = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = written(e, "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
