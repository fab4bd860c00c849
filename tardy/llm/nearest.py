"""Nearest neighbours over low-dimensional stable projections in a kd-tree.

Vectors of length 1 are projected by Gaussian rows (2-stable), and a kd-tree
holds the projections.  A query opens the tree's leaves in the order of their
least projected distance and verifies the vectors in them exactly, until the
stopping test holds: a vector nearer than the k-th found one would, with
chance ``CONFIDENCE``, have had a projected distance below that of the next
leaf (squared ratio of the two distances: chi-square with as many degrees of
freedom as projections).

Vectors are dealt to shards and queries to blocks of bounded size; every
pair of a shard and a block is a task group that builds its tree and sends
its k best, and a window takes the best k of each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import doubles, matrix, unit_rows, usable

PROJECTIONS = 12
CONFIDENCE = 0.98
LEAF = 64
SHARD_ROWS, BLOCK_QUERIES = 8192, 512


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection."""
    def cdf(x: float) -> float:
        half, term, total = x / 2, 1.0, 1.0
        for j in range(1, freedom // 2):
            term *= half / j
            total += term
        return 1 - math.exp(-half) * total
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of a kd-tree (median cuts of the widest side) with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            at = todo.pop()
            if len(at) > leaf:
                own = points[at]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                half = np.argpartition(own[:, axis], len(at) // 2)
                todo += [at[half[:len(at) // 2]], at[half[len(at) // 2:]]]
            else:
                self.leaves.append(at)
        self.low = np.array([points[a].min(axis=0) for a in self.leaves])
        self.high = np.array([points[a].max(axis=0) for a in self.leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """[query, leaf] least squared distance to the leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for j in range(queries.shape[1]):
            q = queries[:, j, None]
            gap = np.maximum(np.maximum(self.low[None, :, j] - q, q - self.high[None, :, j]), 0)
            out += gap * gap
        return out


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
           projections: int = PROJECTIONS, confidence: float = CONFIDENCE, seed: int = 5):
    """(query number, vector number, cosine) of the k best found per query,
    ties to the smaller id; a vector with the query's id is no candidate."""
    lines = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], projections))
    stop = chi_square_quantile(confidence, projections)
    x, q = unit_rows(vectors), unit_rows(queries)
    tree = KdTree(x @ lines)
    bounds = tree.distances(q @ lines)
    sizes = np.array([len(a) for a in tree.leaves])
    # vectors in leaf order, so that an opened leaf is a slice
    order = np.concatenate(tree.leaves) if tree.leaves else np.zeros(0, np.int64)
    x, ends = x[order], np.cumsum(sizes)
    own = ids[order]
    out = []
    for i in range(len(q)):
        near = np.argsort(bounds[i], kind="stable")
        ahead = np.r_[bounds[i][near][1:], np.inf]
        scores, places, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 4
        while at < len(near):
            opened = near[at:at + step]
            at += len(opened)
            step *= 2 if at > 8 else 1
            place = np.concatenate([np.arange(ends[n] - sizes[n], ends[n]) for n in opened])
            place = place[own[place] != query_ids[i]]
            scores = np.r_[scores, x[place] @ q[i]]
            places = np.r_[places, place]
            if len(scores) > k:
                # all that may tie with the k-th stay
                least = np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9
                kept = scores >= least
                scores, places = scores[kept], places[kept]
            if len(scores) >= k and at < len(near):
                farthest = max(0.0, 2 - 2 * np.partition(scores, len(scores) - k)[len(scores) - k])
                if ahead[at - 1] > 0 and ahead[at - 1] >= stop * farthest:
                    break
        # the measure itself, by one and the same sum for every vector
        b, a = vectors[order[places]], queries[i]
        exact = (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))
        best = np.lexsort((own[places], -exact))[:k]
        out.append((np.full(len(best), i), order[places[best]], exact[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id",
                       vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found (by cosine)
    of every row for which ``is_query`` (a condition on the id) holds.

    Vectors that are null, zero or hold null or non-finite components, and
    rows with a null id, take no part; vectors of another dimension are no
    candidates.  Of repeated query rows one asks (the smallest vector);
    repeated candidates are candidates each; fewer than k candidates give
    fewer rows, an empty table none.  Other columns are ignored.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles(vectors, vector_col).alias("v"))
    valid = source.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    asked = valid.filter(is_query(F.col("vec_id"))).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    # one pass counts both sides
    n, n_asked = valid.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n_asked / BLOCK_QUERIES))

    def part(name: str, count: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    points = valid.withColumn("shard", part("shard", shards)).withColumn("block", every(blocks))
    queries = asked.withColumn("block", part("block", blocks)).withColumn("shard", every(shards))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left["dim"][0].as_py()
        q_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        a, b, score = search(matrix(left["v"], dim), q_ids, matrix(right["v"], dim), ids, k, **options)
        return pa.table([q_ids[a], ids[b], score], schema=schema)

    keys = ["dim", "shard", "block"]
    best = queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
