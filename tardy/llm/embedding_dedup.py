"""Near-duplicate embeddings by random-hyperplane signs in several tables.

A table's key is the signs of a vector against some random hyperplanes; only
vectors of the same label that share a key in a table are compared, by their
exact cosine in double precision.  The number of signs follows from how many
vectors the largest label has, the number of tables from the wanted recall
at the threshold.

Equal vectors are one node with a count.  A bucket beyond ``BLOCK`` nodes is
cut into blocks, and each pair of blocks is a unit of its own; a pair of
nodes is counted in the first table in which it shares a key.  A unit emits
one row per node (its number of links there and the root of its group
there), never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows
from .components import connected_components
from .vectors import doubles, matrix, unit_rows, usable

THRESHOLD = 0.98
#: chance that a pair right at the threshold shares no key
MISS = 1e-6
#: nodes of a bucket that are compared at once; expected nodes of a random bucket
BLOCK, TARGET = 2048, 32
#: nodes that a task group holds, about
GROUP_ROWS = 8192


def plan_tables(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(signs per key, tables) for labels of up to ``largest`` nodes."""
    signs = min(30, max(4, math.ceil(math.log2(max(largest, 1) / TARGET + 1))))
    hit = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log(1 - hit))


def sign_keys(x: np.ndarray, signs: int, tables: int, seed: int = 11) -> np.ndarray:
    """[vector, table] keys."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * signs))
    bits = (x @ planes > 0).reshape(len(x), tables, signs)
    return (bits * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2).astype(np.int32)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n nodes over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(node, weight, keys, table, x, side, threshold):
    """(node, root node, links) of the nodes of one unit that have links."""
    cut = len(node) if side is None else int((side == 0).sum())
    order = slice(None) if side is None else np.argsort(side, kind="stable")
    node, weight, keys, x = node[order], weight[order], keys[order], x[order]
    left = x if side is None else x[:cut]
    right_at = 0 if side is None else cut
    near = left @ x[right_at:].T >= threshold
    if side is None:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    b = b + right_at
    fresh = np.ones(len(a), bool)
    for t in range(table):
        fresh &= keys[a, t] != keys[b, t]
    links = np.bincount(a[fresh], weights=weight[b[fresh]], minlength=len(node)) \
        + np.bincount(b[fresh], weights=weight[a[fresh]], minlength=len(node))
    at = np.flatnonzero(links)
    return node[at], node[_roots(len(node), a[fresh], b[fresh])][at], links[at].astype(np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Only vectors of equal, non-null label and equal dimension are compared;
    vectors that are null, zero or hold null or non-finite components, and
    rows with a null id, have no links (component: own id, kept).  Repeated
    rows are vectors of their own that link with each other but share an id,
    so they share the component and are kept alike; so do different vectors
    of one id, each of which keeps its own links.  An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                            doubles(vectors, vector_col).alias("v"),
                            F.col(label_col).cast("string").alias("label"))
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    every = source.select("vec_id", "label", "v", ok.alias("ok"), F.size("v").alias("dim"),
                          F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    valid = every.filter("ok")
    same = ["label", "dim", "k1", "k2"]
    # equal vectors are one node, numbered anew: an id may have several vectors
    nodes = scratch.table(valid.groupBy(*same).agg(F.min("vec_id").alias("owner"), F.count("*").alias("weight"))
                          .withColumn("node", F.monotonically_increasing_id()), "nodes")
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    signs, tables = plan_tables(largest or 1, threshold)

    def sign(batches):
        schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int32()))])
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = sign_keys(unit_rows(matrix(part.column("v"), dim)), signs, tables)
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables)
                signed = rows({"node": part.column("node"), "keys": pa.ListArray.from_arrays(
                    ends, pa.array(keys.ravel()))}, schema)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names), signed.column("keys")],
                    names=[*part.schema.names, "keys"])

    # the vector of a node is that of its smallest id (repeated rows: any copy)
    owners = (valid.withColumnRenamed("vec_id", "owner").join(nodes, [*same, "owner"])
              .select("node", "weight", "label", "dim", "v").dropDuplicates(["node"]))
    signed = scratch.table(owners.mapInArrow(
        sign, "node long, weight long, label string, dim int, v array<double>, keys array<int>"), "signed")
    bucket = ["label", "dim", "table", "key"]
    spread = signed.select("node", "weight", "label", "dim", "v", "keys",
                           F.posexplode("keys").alias("table", "key"))
    sizes = (signed.select("label", "dim", F.posexplode("keys").alias("table", "key"))
             .groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    sizes = scratch.table(sizes, "buckets")
    total = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_ROWS))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = (spread.join(sizes, bucket).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .withColumn("side", F.when(F.col("i") == F.col("j"), -1).when(F.col("own") == F.col("i"), 0).otherwise(1))
             .withColumn("unit", F.xxhash64(*bucket, "i", "j"))
             .withColumn("task", F.pmod("unit", F.lit(groups)))
             .select("task", "unit", "table", "dim", "side", "node", "weight", "keys", "v"))

    def compare(group: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])
        unit = group["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        group, unit = group.take(pa.array(order)), unit[order]
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        made = []
        for a, b in zip(cuts, [*cuts[1:], len(unit)]):
            part = group.slice(a, b - a)
            dim, side = part["dim"][0].as_py(), part["side"].to_numpy()
            made.append(_compare(part["node"].to_numpy(), part["weight"].to_numpy().astype(float),
                                 np.asarray(part["keys"].combine_chunks().flatten()).reshape(b - a, -1),
                                 part["table"][0].as_py(), unit_rows(matrix(part["v"], dim)),
                                 None if side[0] < 0 else side, threshold))
        return pa.table([np.concatenate([m[k] for m in made]) for k in range(3)], schema=schema)

    found = scratch.table(units.groupBy("task").applyInArrow(compare, "node long, root long, n long"), "links")
    # an id with several vectors ties their nodes together
    several = (valid.groupBy("vec_id").agg(*[f(F.struct(*same)).alias(n) for n, f in (("low", F.min), ("high", F.max))])
               .filter("low <> high").select("vec_id"))
    owned = valid.join(several, "vec_id", "left_semi").join(nodes, same).select("vec_id", "node").distinct()
    ties = (owned.groupBy("vec_id").agg(F.min("node").alias("a")).join(owned, "vec_id")
            .select("a", F.col("node").alias("b")))
    components = scratch.table(connected_components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(ties), scratch), "components")
    named = (components.join(nodes.select("node", "owner"), "node").groupBy("component")
             .agg(F.min("owner").alias("component_id")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    resolved = (nodes.join(counts, "node", "left")
                .join(components.join(named, "component").select("node", "component_id"), "node", "left")
                .select(*same, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                        F.coalesce("component_id", "owner").alias("component_id")))
    linked = valid.join(resolved, same).select("vec_id", "n_links", "component_id")
    alone = every.filter("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id")
    out = linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return scratch.result(out)
