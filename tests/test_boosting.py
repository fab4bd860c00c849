"""Boosted trees of many rows: the library's trees, from passes over codes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy.catalog import regression_model_table
from tardy.functions import constants as K
from tardy.operators import boosting as B
from tardy.operators import ml as M


def body(tree):
    return tree.toDebugString.split("\n", 1)[1]


def noise(k, mod):
    return (F.crc32(F.concat(F.lit(f"{k} "), F.col("id").cast("string")).cast("binary")) % mod).cast("double")


@pytest.fixture(scope="module")
def rows(spark):
    """A one-hot block, a flag and two numbers that do not imply each other."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    t = spark.range(6000).repartition(3, "id").select(
        F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("UniqueCarrier"),
        noise(1, 997).alias("x"), (noise(2, 8191) / 7 - 300).alias("z"), noise(3, 104729).alias("e"))
    t = t.withColumn("y", F.col("x") * 0.37 + F.abs("z") * 0.11 + F.col("e") / 3001
                     + F.when(F.col("UniqueCarrier") == "c3", 41.3).otherwise(0.0))
    stages = [StringIndexer(inputCol="UniqueCarrier", outputCol="i", handleInvalid="keep"),
              OneHotEncoder(inputCols=["i"], outputCols=["UniqueCarrierVec"]),
              VectorAssembler(inputCols=["UniqueCarrierVec", "x", "z"], outputCol="features")]
    from tardy.plans.sizing import materialize
    return materialize(Pipeline(stages=stages).fit(t).transform(t).select("y", "features"))


def test_the_trees_are_the_librarys(spark, rows):
    options = {"labelCol": "y", "maxIter": 4, "maxDepth": 3, "seed": 42}
    own, library = B.BoostedTrees(**options).fit(rows), GBTRegressor(**options).fit(rows)
    assert own.treeWeights == library.treeWeights and own.numFeatures == library.numFeatures
    for a, b in zip(own.trees, library.trees):
        for x, y in zip(body(a).split("\n"), body(b).split("\n"), strict=True):
            if "Predict" in x:  # sums in another order
                assert float(x.split(":")[1]) == pytest.approx(float(y.split(":")[1]), rel=1e-9, abs=1e-9)
            else:
                assert x == y
    a = own.transform(rows).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(library.transform(rows).agg(F.sum("prediction")).first()[0], rel=1e-9)
    assert np.allclose(own.featureImportances.toArray(), library.featureImportances.toArray(), rtol=1e-9)
    errors = own.evaluateEachIteration(rows, "squared")
    assert errors == pytest.approx(library.evaluateEachIteration(rows, "squared"), rel=1e-9)
    # as a part of a saved pipeline it is the library's model
    assert type(own).__name__ == "GBTRegressionModel" and own.getLabelCol() == "y" and own.getMaxDepth() == 3


def test_the_model_query_boosts_over_codes(spark, monkeypatch):
    """The first tree over the trips (whole labels, so nothing is rounded) is
    the library's; a row is 22 codes instead of 86 slots."""
    table = regression_model_table(spark, SF_SMALL)
    prep = M.prepare(*M.random_split(table), K.NUMERIC_FEATURES)
    seen = []
    real = B._grown
    monkeypatch.setattr(B, "_grown", lambda blocks, splits, *a: seen.append(splits) or real(blocks, splits, *a))
    estimator = M.regressors(gbt_iter=3, gbt_depth=5)["GBT Regressor"]
    own = estimator.fit(prep.train)
    library = GBTRegressor(labelCol=K.TARGET, maxIter=3, maxDepth=5, seed=42).fit(prep.train)
    assert len(seen) == 3 and len(seen[0].columns) == len(K.CATEGORICAL_FEATURES) + len(K.NUMERIC_FEATURES)
    assert body(own.trees[0]) == body(library.trees[0])
    a, b = (M.regression_scores(m.transform(prep.train))["rmse"] for m in (own, library))
    assert a == pytest.approx(b, rel=1e-3)


def test_repeated_fits_give_one_model_whatever_the_partitions(spark, rows):
    fit = lambda t: B.BoostedTrees(labelCol="y", maxIter=12, maxDepth=3, seed=42).fit(t)
    one = fit(rows)
    assert [body(t) for t in fit(rows).trees] == [body(t) for t in one.trees]  # past a checkpoint
    rmse = [M.regression_scores(m.transform(rows), "y")["rmse"] for m in (one, fit(rows.coalesce(1)))]
    assert rmse[0] == pytest.approx(rmse[1], rel=0.02)  # the sample of candidate splits follows the partitions


def test_what_the_passes_do_not_know_is_the_librarys(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "_grown", lambda *a: pytest.fail("the library has to fit this"))
    base = B.BoostedTrees(labelCol="y", maxIter=1, maxDepth=2, seed=1)
    for other in ({base.lossType: "absolute"}, {base.subsamplingRate: 0.5}, {base.featureSubsetStrategy: "sqrt"}):
        assert base.copy(other).fit(rows).getNumTrees == 1
    assert B.code_columns({"nominal": [{"idx": 0, "vals": ["a", "b", "c"]}]}) is None


def test_a_constant_label_and_inputs_without_splits(spark):
    t = spark.range(40).select(F.lit(3.0).alias("y"), (F.col("id") % 4).cast("double").alias("a"), F.lit(1.0).alias("b"))
    for columns in (["a"], ["b"]):
        rows = VectorAssembler(inputCols=columns, outputCol="features").transform(t)
        options = {"labelCol": "y", "maxIter": 2, "maxDepth": 3, "seed": 42}
        own, library = B.BoostedTrees(**options).fit(rows), GBTRegressor(**options).fit(rows)
        assert [body(x) for x in own.trees] == [body(x) for x in library.trees]
    with pytest.raises(Exception):
        B.BoostedTrees(labelCol="y").fit(rows.filter("y > 3"))


def test_vectors_become_codes():
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())),
                      ("values", pa.list_(pa.float64()))])
    vectors = pa.array([{"type": 0, "size": 4, "indices": [1, 3], "values": [1.0, 2.5]},
                        {"type": 1, "size": None, "indices": None, "values": [0.0, 0.0, 1.0, -1.0]},
                        {"type": 0, "size": 4, "indices": [], "values": []}], kind)
    columns, thresholds = [(0, 3), (3, 0)], [np.array([]), np.array([-1.0, 0.5])]
    want = [[2, 3, 0], [2, 0, 1]]
    assert B._coded(vectors, columns, thresholds, "uint8").tolist() == want
    assert B._coded(vectors.slice(1), columns, thresholds, "uint8").tolist() == [r[1:] for r in want]
    two = pa.array([{"type": 0, "size": 4, "indices": [0, 1], "values": [1.0, 1.0]}], kind)
    with pytest.raises(ValueError):
        B._coded(two, columns, thresholds, "uint8")
