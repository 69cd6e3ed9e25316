"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park, unpark

#: Edges that one task contracts at a time before it emits what is left of them.
LOCAL_EDGES = 200_000


class Forest:
    """Union-find on hashable ids; the root of a tree is its smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (r := up.get(root, root)) != root:
            root = r
        while x != root:
            x, up[x] = up.get(x, x), root
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task become a star for each local component."""
    forest, seen = Forest(), 0

    def out() -> pa.RecordBatch:
        nodes = [n for n in forest.up if forest.find(n) != n]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(n) for n in nodes], pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(u, v)
        seen += b.num_rows
        if seen >= LOCAL_EDGES:
            yield out()
            forest, seen = Forest(), 0
    if forest.up:
        yield out()


def _settled(e: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself: all components are stars."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    node = ends.groupBy("node").agg(F.sum("child").alias("up"), F.max("parent").alias("down"))
    return not node.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest reachable node.

    Rows with a null end and loops are no edges. Every round is joins on a node (skewed ones split by
    adaptive execution) and aggregations with partial sums; the state is a written table of at most
    one edge a node and round, so neither driver nor task holds a component.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = park(e.mapInArrow(_contract, "u long, v long").distinct())
    for _ in range(most):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small, "u").select("u", "v", "m")
        nxt = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("u", "v")).where("u <> v").distinct()
        nxt = park(nxt)
        unpark(e)
        e = nxt
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def as_int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())
