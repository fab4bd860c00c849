"""Random forests of many rows.

``ForestClassifier`` (two classes) and ``ForestRegressor`` are the library's
random forests with the same parameters, candidate splits, choice of splits
and kind of model; only the passes over the rows are their own, over codes as
in ``boosting.py``.  The library keeps every row as an object with its slots
as whole numbers and a count per tree, most of a KB, and adds statistics in
tables that no processor cache holds.  Here a row is a few codes and a byte
per tree, and the statistics of a tree's level are counted column by column.

Every tree sees each row as often as a Poisson number of mean one says, and
every node a random choice of slots, both drawn from the seed.  The draws are
not the library's (those come from generators of the JVM, by number of
partition, so that they change with the files and cores): the forest is
another one of the same kind.  Without bootstrap and choice of slots the trees
are the library's.

The statistics of a tree's level are added up by tasks, which also choose the
splits; the driver gets the chosen ones.  Trees of one pass are as many as
their statistics allow.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import (EPSILON, Splits, _places, _unpacked, coded_columns, coded_rows, grow, library_model,
                       library_thresholds, mean, pruned, rows_of, variance)

CHUNK_ROWS, TASKS_PER_CORE = 1 << 16, 2
#: cells of the statistics that a task holds in one pass
PASS_CELLS = 1 << 22
#: the count of the second class in a number with that of all: more than the
#: counts of a block (its rows times the most that a byte holds)
PACK = float(1 << 26)


def gini(stats) -> np.ndarray:
    """Of (count, count of the second class)."""
    n, p = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, 1.0 - ((n - p) / n) ** 2 - (p / n) ** 2, 0.0)


def slots_per_node(strategy: str, slots: int, trees: int, classes: bool) -> int | None:
    """Slots that a node may use; None for a setting left to the library."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    found = {"all": slots, "sqrt": math.ceil(math.sqrt(slots)), "onethird": math.ceil(slots / 3)}
    return found.get(strategy)


# ---------------------------------------------------------------- passes over the rows
def _bagged(index: int, rows, columns: int, kind: str, trees: int, seed: int, bootstrap: bool):
    """Blocks with how often each tree sees each row."""
    for number, row in enumerate(rows):
        codes, label, _ = _unpacked(row, columns, kind)
        seen = np.ones((trees, len(label)), np.uint8)
        if bootstrap:
            for t in range(trees):
                seen[t] = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, t, index, number]).poisson(1.0, len(label))
        yield codes, label, seen


def _level(blocks, plan, trees, levels: int, bins: list[int], kinds: int):
    """(tree, statistics) of the open nodes of a level: per column an array
    (statistic, asking node, code), all in one vector."""
    plan, trees = plan.value, trees.value
    sums, parts, positions = {}, {}, {}
    for t, (slot_of, asking) in plan.items():
        sums[t], parts[t] = _shaped(None, asking, bins, kinds)
        positions[t] = [_position(at, int(slot_of.max()) + 1) for at in asking]
    for codes, label, seen in blocks:
        for t, (slot_of, _) in plan.items():
            if kinds == 2:  # both counts in one number, told apart after the block
                packed, into = _shaped(None, plan[t][1], bins, 1)
            else:
                packed, into = None, parts[t]
            for start in range(0, len(label), CHUNK_ROWS):
                cut = slice(start, start + CHUNK_ROWS)
                here, weight = codes[:, cut], seen[t, cut]
                slot = slot_of.take(_places(here, *trees[t], levels))
                rows = np.flatnonzero((slot >= 0) & (weight > 0))
                slot, weight, target = slot.take(rows), weight.take(rows).astype(np.float64), label[cut].take(rows)
                if kinds == 2:
                    weights = [weight * (1 + PACK * target)]
                else:
                    weights = [weight, weight * target, weight * target * target]
                for c, b in enumerate(bins):
                    at, part = positions[t][c], into[c]
                    nodes = part.shape[1]
                    if not nodes:
                        continue
                    place, row, of = slot, rows, weights
                    if at is not None:
                        place = at.take(slot)
                        asked = np.flatnonzero(place >= 0)
                        place, row, of = place.take(asked), rows.take(asked), [w.take(asked) for w in weights]
                    key = place * b + here[c].take(row)
                    for k, w in enumerate(of):
                        part[k] += np.bincount(key, w, nodes * b).reshape(nodes, b)
            if packed is not None:
                second = np.floor(packed / PACK)
                for part, mixed, p in zip(parts[t], into, _shaped(second, plan[t][1], bins, 1)[1]):
                    part[0] += mixed[0] - p[0] * PACK
                    part[1] += p[0]
    yield from sums.items()


def _shaped(vector, asking, bins: list[int], kinds: int):
    """A vector of statistics (zeros if not given) and its parts by column."""
    shapes = [(kinds, len(at), b) for at, b in zip(asking, bins)]
    ends = np.cumsum([math.prod(x) for x in shapes])
    vector = np.zeros(ends[-1]) if vector is None else vector
    return vector, [p.reshape(x) for p, x in zip(np.split(vector, ends[:-1]), shapes)]


def _position(asking: np.ndarray, nodes: int) -> np.ndarray | None:
    """Node to its place among the asking ones; None if all ask."""
    if len(asking) == nodes:
        return None
    out = np.full(nodes, -1)
    out[asking] = np.arange(len(asking))
    return out


def _chosen(item, plan, splits: Splits, seed: int, levels: int, slots: int, some: int, kinds: int):
    t, sums = item
    _, asking = plan.value[t]
    nodes = int(plan.value[t][0].max()) + 1
    parts = _shaped(sums, asking, splits.bins, kinds)[1]
    return t, splits.best(parts, nodes, asking, _allowed(seed, t, levels, nodes, slots, some))


def _allowed(seed: int, tree: int, levels: int, nodes: int, slots: int, some: int) -> np.ndarray:
    """Which slots each open node of a level may use."""
    out = np.ones((nodes, slots), bool)
    if some < slots:
        draw = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, tree, levels, 1 << 32]).random((nodes, slots))
        out = draw.argsort(axis=1).argsort(axis=1) < some
    return out


# ---------------------------------------------------------------- the forest
def _grown(blocks, splits: Splits, trees: int, depth: int, seed: int, slots: int, some: int, kinds: int) -> list[dict]:
    """The trees: nodes by heap place (statistics, gain, split)."""
    context, size = blocks.context, (1 << depth) - 1
    cores = max(1, context.defaultParallelism)
    down = [(np.zeros(size, np.int64), np.zeros((size, len(splits.codes)), np.uint8)) for _ in range(trees)]
    forest: list[dict[int, list]] = [{} for _ in range(trees)]
    open_nodes = {t: [0] for t in range(trees)}
    for level in range(depth):
        plans: list[dict] = [{}]
        cells = 0
        for t, places in open_nodes.items():
            slot_of = np.full((2 << level) - 1, -1)
            slot_of[places] = np.arange(len(places))
            allowed = _allowed(seed, t, level, len(places), slots, some)
            asking = [np.flatnonzero(allowed[:, first:first + max(wide, 1)].any(axis=1)) for first, wide in splits.columns]
            more = kinds * sum(len(at) * b for at, b in zip(asking, splits.bins))
            if plans[-1] and cells + more > PASS_CELLS:
                plans.append({})
                cells = 0
            plans[-1][t] = slot_of, asking
            cells += more
        sent = context.broadcast(down)
        after: dict[int, list[int]] = {}
        for plan in plans:
            known = context.broadcast(plan)
            sums = blocks.mapPartitions(partial(_level, plan=known, trees=sent, levels=level, bins=splits.bins, kinds=kinds))
            choose = partial(_chosen, plan=known, splits=splits, seed=seed, levels=level, slots=slots, some=some, kinds=kinds)
            for t, found in sums.reduceByKey(np.add, min(cores, len(plan))).map(choose).collect():
                total, gain, pick, left, rest, swap = found
                if not level:
                    forest[t][0] = [total[:, 0], None, None]
                for i, place in enumerate(open_nodes[t]):
                    pair = grow(forest[t], place, splits, *down[t], gain[i], pick[i], (left[:, i], rest[:, i]), swap[i])
                    after.setdefault(t, []).extend(child for child, side in pair if abs(splits.impurity(side)) >= EPSILON)
            known.destroy()
        sent.destroy()
        open_nodes = {t: sorted(after[t]) for t in sorted(after) if after[t]}
        if not open_nodes:
            break
    return forest


def _fit_forest(self, dataset: DataFrame, classes: bool):
    """The forest, or None where the library has to fit it."""
    columns = coded_columns(self, dataset)
    if columns is None:
        return None
    slots, trees, seed = columns[-1][0] + max(columns[-1][1], 1), self.getNumTrees(), self.getSeed()
    some = slots_per_node(self.getFeatureSubsetStrategy(), slots, trees, classes)
    if some is None:
        return None
    if classes:
        top = dataset.agg(F.max(F.col(self.getLabelCol()).cast("double"))).first()[0]
        if top != 1.0 or self.getImpurity() != "gini" or self.isSet(self.thresholds):
            return None
    algorithm = "Classification" if classes else "Regression"
    thresholds = library_thresholds(
        self, dataset, columns, lambda of, nominal, kinds: of.getOldStrategy(
            nominal, 2 if classes else 0, getattr(kinds, algorithm)(), of.getOldImpurity()), trees, 2 if classes else 0)
    bins, _, kind, coded = coded_rows(self, dataset, columns, thresholds)
    kinds, impurity, predict, kept = (2, gini, lambda s: float(2 * s[1] > s[0]), lambda s: (s[0] - s[1], s[1])) if classes \
        else (3, variance, mean, list)
    splits = Splits(columns, thresholds, bins, self.getMinInstancesPerNode(), self.getMinInfoGain(), impurity)
    blocks = coded.rdd.mapPartitionsWithIndex(partial(
        _bagged, columns=len(columns), kind=kind, trees=trees, seed=seed,
        bootstrap=self.getBootstrap() and trees > 1))
    # each task sends statistics of all trees, so there are a few tasks per core
    most = max(1, TASKS_PER_CORE * blocks.context.defaultParallelism)
    if blocks.getNumPartitions() > most:
        blocks = blocks.coalesce(most)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = _grown(blocks, splits, trees, self.getMaxDepth(), seed, slots, some, kinds)
    finally:
        blocks.unpersist()
    saved = []
    for t, nodes in enumerate(forest):
        pruned(nodes, predict)
        saved += rows_of(nodes, t, predict, impurity, kept)
    model = RandomForestClassificationModel if classes else RandomForestRegressionModel
    package = model.__module__.split(".")[-1]
    return library_model(self, dataset.sparkSession, model, f"org.apache.spark.ml.{package}.DecisionTree{algorithm}Model",
                         saved, [1.0] * trees, slots, **({"numClasses": 2} if classes else {}))


class ForestClassifier(RandomForestClassifier):
    """See the module."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        return _fit_forest(self, dataset, True) or super()._fit(dataset)


class ForestRegressor(RandomForestRegressor):
    """See the module."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        return _fit_forest(self, dataset, False) or super()._fit(dataset)
