"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no neighbour list is ever gathered; each round is a written table. Tasks first shrink their own edges to a
spanning forest. Edges may repeat and may be loops; without edges there are no components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm.common import Scratch


class UnionFind:
    """Over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.parent))), np.int64, len(self.parent))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) with the same components as the edges a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    found = UnionFind(len(nodes))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        found.union(x, y)
    roots = found.roots()
    other = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[other], nodes[roots[other]]


def forest_stream(batches, most: int = 200_000):
    """Batches of (a, b) with fewer edges and the same components; holds at most about `most` edges at a time. For a task's own edges as they are made, so that no second Python worker is needed."""
    held, size = [], 0

    def out():
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += batch.num_rows
        if size > most:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def local_forest(edges: DataFrame) -> DataFrame:
    """forest_stream over a table's tasks."""
    return edges.select("a", "b").mapInArrow(forest_stream, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component."""
    now = scratch.written(local_forest(edges).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if size == before:
            break
        before = size
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = scratch.written(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = down.join(lowest, F.col("a") == F.col("u"))
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = scratch.written(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        scratch.drop(now, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
