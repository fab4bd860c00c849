"""Boosted regression trees of many rows.

``BoostedTrees`` is the library's ``GBTRegressor`` with the same parameters,
candidate splits, choice of splits and kind of model; only the passes over the
rows are its own.  The library adds three statistics of every slot (one-hot
slots included) for every row of every level.  Here each row is a few codes:
the hot slot of each one-hot block and the bin of each other slot.  A level's
statistics are numpy counts over the codes, a slot's "rest" is the node minus
the slot, and of two siblings only the smaller one is counted: the other is
what remains of their parent.

Candidate splits that divide the rows of a node alike have the same gain but
for rounding, which decides between them in the library; here the first wins.

Rows are dealt in blocks (codes, label, prediction) that Spark keeps and may
move to disk; a task holds one block, the driver the statistics of one level.
A setting that the passes do not know (other loss, weights, subsamples,
validation rows, nominal inputs) is left to the library.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.sizing import delete_path, scratch_path
from ..plans.shipping import ship_package

BLOCK_ROWS, CHUNK_ROWS = 1 << 17, 1 << 15
#: task results that the driver adds up itself; more are added up by tasks
RESULTS = 64
EPSILON = 2.0 ** -52
#: share of a gain that counts as rounding
TIE = 1e-9
#: count, sum and sum of squares
STATS = 3


# ---------------------------------------------------------------- columns of codes
def code_columns(attributes: dict) -> list[tuple[int, int]] | None:
    """(first slot, width) per column: a one-hot block has its width, any
    other binary slot 1, a numeric slot 0.  None for nominal slots."""
    if "nominal" in attributes:
        return None
    binary = {a["idx"]: a.get("name", "") for a in attributes.get("binary", [])}
    slots = sorted([*binary, *(a["idx"] for a in attributes.get("numeric", []))])
    if slots != [*range(len(slots))] or not slots:
        return None
    out: list[tuple[int, int]] = []
    block = None
    for i in slots:
        here = next((c for c in K.CATEGORICAL_FEATURES if binary.get(i, "").startswith(f"{c}Vec_")), None)
        if here is not None and here == block:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((i, 1 if i in binary else 0))
        block = here
    return out


def _entries(vectors: pa.StructArray):
    """(row, slot, value) of the stored entries of sparse and dense vectors."""
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    values = vectors.field("values")
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), sizes)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot[sparse[row]] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    return row, slot, values.flatten().to_numpy(zero_copy_only=False)


def _coded(vectors: pa.StructArray, columns, thresholds, kind: str) -> np.ndarray:
    n = len(vectors)
    row, slot, value = _entries(vectors)
    first, wide = (np.array(x) for x in zip(*columns))
    of = np.repeat(np.arange(len(columns)), np.maximum(wide, 1))[slot]
    codes, numbers = np.zeros((len(columns), n), kind), np.zeros((len(columns), n))
    hot = (wide[of] > 0) & (value != 0)
    place, code = (of[hot], row[hot]), slot[hot] - first[of[hot]] + 1
    codes[place] = code
    if (value[hot] != 1).any() or (codes[place] != code).any():
        raise ValueError("a one-hot block has another value than 0 and 1, or two hot slots in a row")
    number = wide[of] == 0
    numbers[of[number], row[number]] = value[number]
    for c in np.flatnonzero(wide == 0):
        codes[c] = np.searchsorted(thresholds[c], numbers[c], "left")
    return codes


def _blocks(batches, columns, thresholds, kind: str):
    """Arrow batches (label, vector) to blocks: number of rows, codes, labels."""
    held, rows = [], 0

    def block():
        codes = np.concatenate([c for c, _ in held], axis=1)
        label = np.concatenate([y for _, y in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([len(label)], pa.int32()), pa.array([codes.tobytes()], pa.binary()),
             pa.array([label.tobytes()], pa.binary())], names=["n", "codes", "label"])

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            held.append((_coded(part.column(1), columns, thresholds, kind),
                         part.column(0).to_numpy(zero_copy_only=False).astype(np.float64)))
            rows += part.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def _unpacked(row, columns: int, kind: str):
    label = np.frombuffer(bytes(row["label"]), np.float64)
    return np.frombuffer(bytes(row["codes"]), kind).reshape(columns, row["n"]), label, np.zeros(row["n"])


# ---------------------------------------------------------------- passes over the rows
def _places(codes: np.ndarray, column: np.ndarray, right: np.ndarray, levels: int) -> np.ndarray:
    """Heap place (root 0) of each row after ``levels`` levels; below a leaf
    a row goes on to the left."""
    n = codes.shape[1]
    flat, at = np.ascontiguousarray(codes).ravel(), np.arange(n)
    wide, table = right.shape[1], right.ravel()
    place = np.zeros(n, np.int64)
    for _ in range(levels):
        code = flat.take(column.take(place) * n + at)
        place = 2 * place + 1 + table.take(place * wide + code)
    return place


def _targets(label: np.ndarray, prediction: np.ndarray, first: bool) -> np.ndarray:
    """Labels for the first tree, then the negative gradient of the square."""
    return label if first else 2.0 * (label - prediction)


def _statistics(blocks, tree, levels: int, slot_of: np.ndarray, nodes: int, bins: list[int], first: bool):
    """Count, sum and sum of squares of the targets per counted node and code
    of every column: one array (statistic, node, code) per task."""
    offsets = np.concatenate([[0], np.cumsum(bins)])
    total = np.zeros((STATS, nodes, offsets[-1]))
    for codes, label, prediction in blocks:
        for start in range(0, len(label), CHUNK_ROWS):
            cut = slice(start, start + CHUNK_ROWS)
            here, target = codes[:, cut], _targets(label[cut], prediction[cut], first)
            if levels:
                slot = slot_of.take(_places(here, *tree, levels))
                kept = np.flatnonzero(slot >= 0)
                if not len(kept):
                    continue
                slot, here, target = slot.take(kept), here.take(kept, axis=1), target.take(kept)
            square = target * target
            for c, b in enumerate(bins):
                key = slot * b + here[c] if levels else here[c].astype(np.int64)
                part = total[:, :, offsets[c]:offsets[c + 1]]
                for s, weight in enumerate((None, target, square)):
                    part[s] += np.bincount(key, weight, nodes * b).reshape(nodes, b)
    yield total


def _advanced(block, tree, values: np.ndarray, levels: int, weight: float):
    """The block with the tree's share added to its predictions."""
    codes, label, prediction = block
    out = np.empty_like(prediction)
    for start in range(0, len(label), CHUNK_ROWS):
        cut = slice(start, start + CHUNK_ROWS)
        out[cut] = prediction[cut] + weight * values.take(_places(codes[:, cut], *tree, levels))
    return codes, label, out


# ---------------------------------------------------------------- one tree
def variance(stats) -> np.ndarray:
    """Of (count, sum, sum of squares)."""
    n, s, q = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def mean(stats) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


class Splits:
    """Candidate splits in the order of their slots, as the library tries
    them.  Statistics begin with the count and the sum of the labels."""

    def __init__(self, columns, thresholds, bins, least: int, least_gain: float, impurity=variance):
        self.columns, self.thresholds, self.bins = columns, thresholds, bins
        self.least, self.least_gain, self.impurity = least, least_gain, impurity
        self.codes = np.arange(max(bins))
        # per column its first candidate; per candidate its threshold or hot code
        self.candidates = [(c, k) for c, (_, wide) in enumerate(columns)
                           for k in (range(1, wide + 1) if wide else range(bins[c] - 1))]
        self.begins = np.concatenate([[0], np.cumsum([wide or b - 1 for (_, wide), b in zip(columns, bins)])])

    def _gain(self, node, left, right) -> np.ndarray:
        """Decrease of the impurity; -inf for a split that is not allowed."""
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (self.impurity(node) - left[0] / node[0] * self.impurity(left)
                    - right[0] / node[0] * self.impurity(right))
        return np.where((left[0] < self.least) | (right[0] < self.least) | ~(gain >= self.least_gain), -np.inf, gain)

    def _sides(self, c: int, part: np.ndarray):
        """Statistics (statistic, node, candidate) of the node, the left and
        the right side of every split of a column, and whether the hot rows
        are the left ones."""
        below = np.cumsum(part, axis=2)
        node = below[:, :, -1:]
        if not self.columns[c][1]:
            left = below[:, :, :-1]
            return node, left, node - left, np.zeros(left.shape[1:], bool)
        hot = part[:, :, 1:]
        rest = node - hot
        with np.errstate(divide="ignore", invalid="ignore"):  # the smaller mean is on the left
            means = [np.where(x[0] > 0, x[1] / x[0], np.finfo(float).max) for x in (rest, hot)]
        swap = means[1] < means[0]
        return node, np.where(swap, hot, rest), np.where(swap, rest, hot), swap

    def best(self, parts: list[np.ndarray], nodes: int, asking=None, allowed: np.ndarray | None = None):
        """Per node: statistics, gain, candidate, statistics of the left and
        of the right side, and whether the hot rows are the left ones.
        ``parts`` has an array (statistic, node, code) per column, of all
        nodes or of those ``asking`` for the column; ``allowed`` tells the
        slots that a node may use."""
        kinds = len(parts[0])
        total, left, right = (np.zeros((kinds, nodes)) for _ in range(3))
        gain, pick, swap = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, bool)
        for c, (first, wide) in enumerate(self.columns):
            at = np.arange(nodes) if asking is None else asking[c]
            if not len(at):
                continue
            node, lefts, rights, swaps = self._sides(c, parts[c])
            total[:, at] = node[:, :, 0]
            if not swaps.shape[1]:
                continue
            gains = self._gain(node, lefts, rights)
            if wide and allowed is not None:
                gains = np.where(allowed[at, first:first + wide], gains, -np.inf)
            # splits that divide the rows alike differ by rounding: the first is taken
            k = (gains >= gains.max(axis=1, keepdims=True) * (1 - TIE)).argmax(axis=1)
            row = np.arange(len(at))
            better = gains[row, k] > gain[at] * (1 + TIE)
            at, row, k = at[better], row[better], k[better]
            gain[at], pick[at], swap[at] = gains[row, k], self.begins[c] + k, swaps[row, k]
            left[:, at], right[:, at] = lefts[:, row, k], rights[:, row, k]
        return total, gain, pick, left, right, swap

    def split(self, candidate: int, hot_left: bool) -> tuple[tuple, int, np.ndarray]:
        """(slot, left categories or threshold, number of categories), the
        column, and for every code whether its rows go right."""
        c, k = self.candidates[candidate]
        first, wide = self.columns[c]
        if not wide:
            return (first, [float(self.thresholds[c][k])], -1), c, self.codes > k
        return (first + k - 1, [float(hot_left)], 2), c, (self.codes == k) != hot_left


def grow(nodes: dict[int, list], place: int, splits: Splits, column: np.ndarray, right: np.ndarray, gain, candidate,
         sides, hot_left) -> list[tuple[int, np.ndarray]]:
    """Split a node of a tree if that gains anything: its children with their
    statistics."""
    if not gain > 0:
        return []
    split, column[place], right[place] = splits.split(int(candidate), bool(hot_left))
    nodes[place][1:] = float(gain), split
    pair = [(2 * place + 1 + i, side) for i, side in enumerate(sides)]
    for child, side in pair:
        nodes[child] = [side, None, None]
    return pair


def _grown(blocks, splits: Splits, depth: int, first: bool):
    """One tree over the blocks: nodes by heap place (statistics, gain,
    split), and the arrays that send codes down."""
    size = (1 << depth) - 1
    column, right = np.zeros(size, np.int64), np.zeros((size, len(splits.codes)), np.uint8)
    nodes: dict[int, list] = {}
    ends = np.cumsum(splits.bins)[:-1]
    # of each pair of open nodes the counted one is known by its place
    open_nodes, counted, parents = [0], [0], {}
    for level in range(depth):
        slot_of = np.full((2 << level) - 1, -1)
        slot_of[counted] = np.arange(len(counted))
        step = partial(_statistics, tree=(column, right), levels=level, slot_of=slot_of, nodes=len(counted),
                       bins=splits.bins, first=first)
        sums = blocks.mapPartitions(step)
        found = sums.reduce(np.add) if blocks.getNumPartitions() <= RESULTS else sums.treeReduce(np.add)
        known = dict(zip(counted, found.swapaxes(0, 1)))
        for place in open_nodes:
            if place not in known:
                other = place + 1 if place % 2 else place - 1
                known[place] = parents[(place - 1) // 2] - known[other]
        stats = np.stack([known[place] for place in open_nodes], axis=1)
        total, gain, pick, left, rest, swap = splits.best(np.split(stats, ends, axis=2), len(open_nodes))
        if not level:
            nodes[0] = [total[:, 0], None, None]
        children, counted, parents = [], [], {}
        for i, place in enumerate(open_nodes):
            pair = grow(nodes, place, splits, column, right, gain[i], pick[i], (left[:, i], rest[:, i]), swap[i])
            going = [child for child, side in pair if abs(splits.impurity(side)) >= EPSILON]
            if going:
                children += going
                counted.append(min(pair, key=lambda x: x[1][0])[0])
                parents[place] = known[place]
        open_nodes = children
        if not open_nodes:
            break
    return nodes, (column, right)


def pruned(nodes: dict[int, list], predict=mean) -> None:
    """Siblings that are leaves of one prediction become their parent."""
    for place in sorted(nodes, reverse=True):
        if nodes[place][2] is None:
            continue
        pair = [nodes[2 * place + 1], nodes[2 * place + 2]]
        if all(x[2] is None for x in pair) and predict(pair[0][0]) == predict(pair[1][0]):
            nodes[place][1:] = None, None
            del nodes[2 * place + 1], nodes[2 * place + 2]


def rows_of(nodes: dict[int, list], tree: int, predict=mean, impurity=variance, kept=list) -> list[tuple]:
    """Rows of a saved model: nodes numbered parent first, left side first;
    ``kept`` gives the statistics in the library's form."""
    out: list[tuple] = []

    def add(place: int) -> int:
        stats, gain, split = nodes[place]
        number = len(out)
        out.append(())
        below = (-1, -1) if split is None else (add(2 * place + 1), add(2 * place + 2))
        out[number] = (tree, (number, predict(stats), float(impurity(stats)), [float(x) for x in kept(stats)], int(stats[0]),
                              -1.0 if split is None else gain, *below, split or (-1, [], -1)))
        return number

    add(0)
    return out


# ---------------------------------------------------------------- the estimator
_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
          "rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, "
          "leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def coded_columns(estimator, dataset: DataFrame) -> list[tuple[int, int]] | None:
    """Columns of codes of the estimator's vectors, or None where the library
    has to fit."""
    plain = (estimator.getSubsamplingRate() == 1.0 and estimator.getMinWeightFractionPerNode() == 0.0
             and not estimator.isSet(estimator.weightCol) and 1 <= estimator.getMaxDepth() <= 12)
    meta = dataset.schema[estimator.getFeaturesCol()].metadata.get("ml_attr", {})
    return code_columns(meta["attrs"]) if plain and "attrs" in meta else None


def module(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def library_thresholds(estimator, dataset: DataFrame, columns, strategy, trees: int, classes: int = 0) -> list[np.ndarray]:
    """The library's candidate splits of every numeric column, from its own
    sample of the rows.  ``strategy`` gives its settings of a tree."""
    estimator._transfer_params_to_java()
    jvm = dataset.sparkSession._jvm
    impl, util, option = jvm.org.apache.spark.ml.tree.impl, jvm.org.apache.spark.ml.util, jvm.scala.Option
    rows = module(util, "DatasetUtils").extractInstances(
        estimator._java_obj, dataset._jdf, option.apply(classes) if classes else option.empty())
    nominal = util.MetadataUtils.getCategoricalFeatures(dataset._jdf.schema().apply(estimator.getFeaturesCol()))
    algorithms = module(jvm.org.apache.spark.mllib.tree.configuration, "Algo")
    about = impl.DecisionTreeMetadata.buildMetadata(
        rows, strategy(estimator._java_obj, nominal, algorithms), trees, estimator.getFeatureSubsetStrategy())
    found = module(impl, "RandomForest").findSplits(rows, about, estimator.getSeed())
    return [np.array([] if wide else [s.threshold() for s in found[first]], np.float64) for first, wide in columns]


def coded_rows(estimator, dataset: DataFrame, columns, thresholds):
    """Bins per column, width of the vectors, kind of the codes, and a frame
    of blocks."""
    bins = [wide + 1 if wide else len(t) + 1 for (_, wide), t in zip(columns, thresholds)]
    width = columns[-1][0] + max(columns[-1][1], 1)
    kind = "uint8" if max(bins) <= 1 << 8 else "uint16" if max(bins) <= 1 << 16 else "uint32"
    ship_package(dataset.sparkSession)
    rows = dataset.select(F.col(estimator.getLabelCol()).cast("double").alias("label"),
                          F.unwrap_udt(estimator.getFeaturesCol()).alias("vector"))
    coded = rows.mapInArrow(partial(_blocks, columns=columns, thresholds=thresholds, kind=kind),
                            "n int, codes binary, label binary")
    return bins, width, kind, coded


def library_model(estimator, spark: SparkSession, model, tree_class: str, saved: list[tuple], weights: list[float],
                  width: int, **more):
    """The trees as the library's model, by way of its saved form."""
    path = scratch_path(spark, "trees")
    own = {p.name: v for p, v in estimator._paramMap.items()}
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    about = common | {"class": f"org.apache.spark.ml.{model.__module__.split('.')[-1]}.{model.__name__}",
                      "uid": estimator.uid, "paramMap": own,
                      "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()},
                      "numFeatures": width, "numTrees": len(weights)} | more
    shared = {k: own[k] for k in ("featuresCol", "labelCol", "maxDepth", "seed") if k in own}
    one = lambda: json.dumps(common | {
        "class": tree_class, "paramMap": shared, "uid": f"dt_{uuid.uuid4().hex[:12]}", "defaultParamMap": {}})
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, one(), w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(saved, _NODES).coalesce(1).write.parquet(f"{path}/data")
    found = model.load(path)
    delete_path(spark, path)
    return estimator._copyValues(found)


class BoostedTrees(GBTRegressor):
    """See the module."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        plain = (self.getLossType() == "squared" and self.getFeatureSubsetStrategy() == "all"
                 and not self.isSet(self.validationIndicatorCol))
        columns = coded_columns(self, dataset) if plain else None
        if columns is None:
            return super()._fit(dataset)
        spark = dataset.sparkSession
        thresholds = library_thresholds(
            self, dataset, columns, lambda of, nominal, kinds: of.getOldBoostingStrategy(nominal, kinds.Regression())
            .treeStrategy(), 1)
        bins, width, kind, coded = coded_rows(self, dataset, columns, thresholds)
        blocks = coded.rdd.map(partial(_unpacked, columns=len(columns), kind=kind)).persist(StorageLevel.MEMORY_AND_DISK)
        splits = Splits(columns, thresholds, bins, self.getMinInstancesPerNode(), self.getMinInfoGain())
        depth, every, saved, checkpoint, last = self.getMaxDepth(), self.getCheckpointInterval(), [], None, None
        weights = [1.0] + [self.getStepSize()] * (self.getMaxIter() - 1)
        try:
            for t, weight in enumerate(weights):
                if t and every > 0 and t % every == 0 and spark.sparkContext.getCheckpointDir():
                    blocks.checkpoint()  # ends the lineage
                nodes, tree = _grown(blocks, splits, depth, t == 0)  # its first pass keeps the new blocks
                if last:
                    last.unpersist()
                if blocks.isCheckpointed():
                    checkpoint, done = blocks.getCheckpointFile(), checkpoint
                    if done:
                        delete_path(spark, done)
                pruned(nodes)
                saved += rows_of(nodes, t)
                if t + 1 < len(weights):
                    step = partial(_advanced, tree=tree, values=_values(nodes, depth), levels=depth, weight=weight)
                    last, blocks = blocks, blocks.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            for kept in filter(None, (last, blocks)):
                kept.unpersist()
            if checkpoint:
                delete_path(spark, checkpoint)
        return library_model(self, spark, GBTRegressionModel, "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
                             saved, weights, width)


def _values(nodes: dict[int, list], depth: int) -> np.ndarray:
    """Prediction by heap place after ``depth`` levels (rows of a leaf went
    on to the left; below a pruned pair both sides have its prediction)."""
    out = np.zeros((2 << depth) - 1)
    for place in sorted(nodes):
        out[place] = mean(nodes[place][0])
    for place in range(1, len(out)):
        if place not in nodes:
            out[place] = out[(place - 1) // 2]
    return out
