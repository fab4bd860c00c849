"""Forests of many rows: the library's trees where nothing is drawn, forests
of its quality where bootstrap and slots are."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy.catalog import regression_model_table
from tardy.functions import constants as K
from tardy.operators import forests as T
from tardy.operators import ml as M


@pytest.fixture(scope="module")
def prepared(spark):
    rows = M.fill_inputs(regression_model_table(spark, SF_SMALL), K.NUMERIC_FEATURES).withColumn(
        "late", (F.col(K.TARGET) > 30).cast("int"))
    return M.prepare(*M.random_split(rows), K.NUMERIC_FEATURES, labels=["late", K.TARGET])


def body(tree):
    return tree.toDebugString.split("\n", 1)[1]


ONE = {"numTrees": 1, "bootstrap": False, "maxDepth": 6, "seed": 42}


def test_a_tree_of_all_rows_and_slots_is_the_librarys(prepared):
    own, library = (c(labelCol=K.TARGET, **ONE).fit(prepared.train) for c in (T.ForestRegressor, RandomForestRegressor))
    assert body(own.trees[0]) == body(library.trees[0])
    assert np.allclose(own.featureImportances.toArray(), library.featureImportances.toArray(), rtol=1e-9)
    own, library = (c(labelCol="late", **ONE).fit(prepared.train) for c in (T.ForestClassifier, RandomForestClassifier))
    assert type(own) is type(library) and own.numClasses == 2 and own.trees[0].numNodes == library.trees[0].numNodes
    assert np.allclose(own.featureImportances.toArray(), library.featureImportances.toArray(), rtol=1e-9)
    a, b = (m.transform(prepared.test).select("late", "rawPrediction", "probability", "prediction") for m in (own, library))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_drawn_forests_are_as_good_as_the_librarys(prepared, spark):
    own, library = (c(labelCol=K.TARGET, numTrees=20, maxDepth=6, seed=7).fit(prepared.train)
                    for c in (T.ForestRegressor, RandomForestRegressor))
    rmse = [M.regression_scores(m.transform(prepared.train))["rmse"] for m in (own, library)]
    assert rmse[0] == pytest.approx(rmse[1], rel=0.02) and own.getNumTrees == 20
    assert own.featureImportances.toArray().sum() == pytest.approx(1.0)
    own, library = (c(labelCol="late", numTrees=20, maxDepth=6, seed=7).fit(prepared.train)
                    for c in (T.ForestClassifier, RandomForestClassifier))
    area = [M.classification_scores(m.transform(prepared.train), "late")["auc"] for m in (own, library)]
    assert area[0] == pytest.approx(area[1], abs=0.03)
    # the trees differ, and a second fit has the same ones
    assert len({body(t) for t in own.trees}) == 20
    assert [body(t) for t in T.ForestClassifier(labelCol="late", numTrees=20, maxDepth=6, seed=7).fit(prepared.train).trees] \
        == [body(t) for t in own.trees]


def test_the_model_queries_grow_over_codes(prepared, monkeypatch):
    seen = []
    real = T._grown
    monkeypatch.setattr(T, "_grown", lambda blocks, splits, *a: seen.append((len(splits.columns), *a[:2], a[4])) or real(
        blocks, splits, *a))
    forest = M.classifier("late", trees=3, depth=4).fit(prepared.train)
    M.regressors(rf_trees=2, rf_depth=3)["Random Forest"].fit(prepared.train)
    slots = forest.numFeatures
    columns = len(K.CATEGORICAL_FEATURES) + len(K.NUMERIC_FEATURES)
    # the library's shares of slots: root for classes, a third for numbers
    assert seen == [(columns, 3, 4, int(np.ceil(slots ** 0.5))), (columns, 2, 3, -(-slots // 3))]


def test_many_passes_and_tasks_give_the_same_trees(prepared, monkeypatch):
    options = {"labelCol": "late", "numTrees": 6, "maxDepth": 5, "seed": 3}
    whole = T.ForestClassifier(**options).fit(prepared.train)
    monkeypatch.setattr(T, "PASS_CELLS", 1)
    assert [body(t) for t in T.ForestClassifier(**options).fit(prepared.train).trees] == [body(t) for t in whole.trees]
    monkeypatch.setattr(T, "TASKS_PER_CORE", 0)
    wide = prepared.train.repartition(5)
    assert T.ForestClassifier(**options).fit(wide).getNumTrees == 6


def test_weights_are_counted_exactly():
    """Counts of both classes share one number while a block is counted."""

    class Sent:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(1)
    n, bins = T.CHUNK_ROWS + 999, [3, 5]
    codes = np.stack([rng.integers(0, b, n) for b in bins]).astype("uint8")
    label, seen = rng.integers(0, 2, n).astype(float), rng.integers(0, 256, (1, n)).astype("uint8")
    plan = {0: (np.array([-1, 0, 1]), [np.array([0, 1]), np.array([1])])}
    down = (np.zeros(1, np.int64), np.array([[0, 1, 1, 0, 0]], np.uint8))
    (tree, sums), = T._level([(codes, label, seen), (codes, label, seen)], Sent(plan), Sent([down]), 1, bins, 2)
    got = T._shaped(sums, plan[0][1], bins, 2)[1]
    node = (codes[0] > 0).astype(int)
    for c, asking in enumerate(plan[0][1]):
        for i, at in enumerate(asking):
            for code in range(bins[c]):
                w = seen[0][(node == at) & (codes[c] == code)].astype(float)
                y = label[(node == at) & (codes[c] == code)]
                assert got[c][:, i, code].tolist() == [2 * w.sum(), 2 * (w * y).sum()]


def test_draws(spark):
    some = T._allowed(42, 3, 2, 400, 20, 5)
    assert (some.sum(axis=1) == 5).all() and some.sum(axis=0).min() > 50
    assert (T._allowed(42, 3, 2, 400, 20, 5) == some).all() and (T._allowed(42, 4, 2, 400, 20, 5) != some).any()
    row = {"n": 50_000, "codes": bytes(50_000), "label": np.zeros(50_000).tobytes()}
    (_, _, seen), (_, _, other) = T._bagged(0, [row, row], 1, "uint8", 2, -5, True)
    assert abs(seen.mean() - 1) < 0.02 and abs(seen.var() - 1) < 0.03
    assert (seen[0] != seen[1]).any() and (seen != other).any()


def test_what_the_passes_do_not_know_is_the_librarys(prepared, monkeypatch):
    monkeypatch.setattr(T, "_grown", lambda *a: pytest.fail("the library has to fit this"))
    base = T.ForestClassifier(labelCol="late", numTrees=2, maxDepth=2, seed=1)
    for other in ({base.impurity: "entropy"}, {base.subsamplingRate: 0.5}, {base.featureSubsetStrategy: "log2"}):
        assert base.copy(other).fit(prepared.train).getNumTrees == 2
    # one class only
    assert base.fit(prepared.train.filter("late = 0")).getNumTrees == 2
