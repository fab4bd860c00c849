"""Connected components on DataFrames (alternating large-star, small-star).

Each step keeps the components and points more nodes at the smallest id they
know; at the end every node is linked to the smallest id of its component.
A node's neighbours are never gathered: the smallest one is an aggregate,
joined back to the edges, so a node with very many links is split like any
hot join key.  Every step is written to shared storage.  Up to
``ONE_TASK_EDGES`` distinct edges (a few MB) are joined up in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ONE_TASK_EDGES = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _union_find(batches):
    parent: dict[int, int] = {}

    def top(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_pydict(
        {"node": pa.array(nodes, pa.int64()), "component": pa.array([top(n) for n in nodes], pa.int64())})


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long ids);
    the component is its smallest id.  Null ends, loops and repeated edges
    are ignored; no edges give no rows."""
    def state(t: DataFrame) -> tuple:
        r = t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    now = scratch.table(edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(now)
    if before[0] <= ONE_TASK_EDGES:
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        old, now = now, scratch.table(_small_star(_large_star(now)), "edges")
        scratch.forget(old)
        after = state(now)
        if after == before:
            break
        before = after
    # a star per component: its smallest id is no one's larger end
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
