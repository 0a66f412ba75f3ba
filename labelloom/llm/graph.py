"""Connected components by alternating large-star and small-star steps, as joins and grouped minima.

Before each pair of steps every partition replaces its own edges by stars of what
they connect, so few steps are left for what several partitions hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stored


class Forest:
    """Labels of positions; joins report which edges connected something."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                return r
            r = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used_a, used_b = [], []
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, lo, hi = a[open_], b[open_], np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            _, pick = np.unique(hi, return_index=True)  # one edge for each root that gets a parent
            self.up[hi[pick]] = lo[pick]
            used_a.append(a[pick])
            used_b.append(b[pick])
        self.up = self.roots(np.arange(len(self.up)))
        return (np.concatenate(used_a), np.concatenate(used_b)) if used_a else (a, b)


def _toward_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b: each node's neighbours are linked to the least of them.

    A node's minimum is a grouped aggregate and is joined back, so a node with very
    many neighbours is never gathered in one place.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    near = both.join(least, F.col("a") == F.col("at"))
    linked = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (a, b) as an edge from each of its nodes to the least one that it reaches here."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted, so the least position is the least node
        forest = Forest(len(nodes))
        forest.join(at[: len(a)], at[len(a) :])
        own = np.flatnonzero(forest.up != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[forest.up[own]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable. edges: columns a and b of type long; loops are dropped."""
    local = lambda df: stored(df.mapInArrow(_contracted, "a long, b long"))
    now = local(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        # Done if every node has one edge, to a node that has none itself.
        done = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        if done:
            break
        now = local(_toward_minimum(_toward_minimum(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
