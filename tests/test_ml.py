"""Model tests: twins equal the evaluators, save -> load gives the same
predictions, models beat the mean, scoring routes A/B and reports errors."""

import math
import os
import tempfile

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy.catalog import classification_table, enriched_regression, regression_model_table
from tardy.functions import constants as K
from tardy.operators import metrics as MT
from tardy.operators import ml as M


@pytest.fixture(scope="module")
def prepared(spark):
    train, test = raw_split(spark)
    return M.prepare(train, test, K.NUMERIC_FEATURES)


def raw_split(spark):
    return M.random_split(regression_model_table(spark, SF_SMALL))


def raw_test_rows(spark):
    return M.fill_inputs(raw_split(spark)[1], K.NUMERIC_FEATURES_WITH_DEP)


def test_regression_twin_equals_evaluator(spark):
    pred = enriched_regression(spark, SF_SMALL).select(
        K.TARGET, F.col("AvgCarrierHourDelay").alias("prediction"))
    twin = MT.regression_metrics(pred).first()
    ev = RegressionEvaluator(labelCol=K.TARGET, predictionCol="prediction")
    for m in ("rmse", "mae", "r2"):
        assert math.isclose(twin[m], ev.evaluate(pred, {ev.metricName: m}), rel_tol=1e-9)


def test_auc_twin_close_to_evaluator(spark):
    t = classification_table(spark, SF_SMALL).select(
        F.col("DelayOver30").cast("double").alias("label"),
        F.col("AvgCarrierHourDelay").alias("score"))
    twin = MT.auc_rank_sum(t, "score", "label").first().auc
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score").evaluate(t)
    assert abs(twin - ev) < 1e-6


def test_models_beat_the_mean_and_round_trip(spark, prepared):
    fits = M.train_compare(prepared, M.regressors(gbt_iter=5, gbt_depth=3, rf_trees=5, rf_depth=5), "A")
    sd = prepared.test.agg(F.stddev_pop(K.TARGET)).first()[0]
    for f in fits:
        assert all(math.isfinite(v) for v in f.metrics.values())
        assert f.metrics["rmse"] < sd
    board = M.leaderboard(spark, fits)
    assert board.count() == 3
    best = M.best_model(board).first()
    assert best.R2 == max(f.metrics["r2"] for f in fits)
    pipe = M.pick_best(fits).pipeline()
    path = os.path.join(tempfile.mkdtemp(prefix="tardy-model-"), "m")
    M.save_model(pipe, path)
    again = M.load_model(path)
    raw = raw_test_rows(spark)
    a = pipe.transform(raw).select("prediction").collect()
    b = again.transform(raw).select("prediction").collect()
    assert a == b
    assert M.load_model(path + "-missing") is None


def test_importance_names_cover_the_vector(spark, prepared):
    rf = M.regressors(rf_trees=3, rf_depth=3)["Random Forest"].fit(prepared.train)
    names = M.feature_names(prepared.train, prepared.numeric)
    assert len(names) == rf.featureImportances.size and set(prepared.numeric) <= set(names)
    top = M.feature_importance(spark, rf, names, top=5).collect()
    assert len(top) <= 5 and all(r.Importance >= 0 for r in top)


def test_scoring_without_models_gives_error_rows(spark):
    feats = spark.createDataFrame([("r1", "A")], "request_id string, model_type string")
    out = M.score_regression(feats, None, None).first()
    assert out.status == "error" and out.error == "Regression models not loaded"
    out = M.score_classification(feats, None, None).first()
    assert out.status == "error"


def test_non_finite_inputs_become_error_rows(spark, prepared):
    lr = M.regressors()["Linear Regression"].fit(prepared.train)
    pipe = M.PipelineModel(stages=list(prepared.features.stages) + [lr])
    rows = raw_test_rows(spark).limit(4).withColumn(
        "request_id", F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("DepDelay", F.lit(float("nan"))).withColumn("TaxiOut", F.lit(10))
    rows = rows.withColumn("model_type", F.when(F.col("request_id") == "0", "B").otherwise("A"))
    rows = rows.cache()
    out = {r.request_id: r for r in M.score_regression(rows, pipe, pipe).collect()}
    assert len(out) == rows.count()
    b_ids = [r.request_id for r in rows.filter(F.col("model_type") == "B").collect()]
    for rid, r in out.items():
        if rid in b_ids:
            assert r.status == "error" and r.error == "invalid feature value"
        else:
            assert r.status == "success" and r.predicted_delay_minutes is not None


def test_written_features_are_sparse_and_no_row_is_lost(spark, prepared):
    kinds = prepared.train.select(F.unwrap_udt("features")["type"].alias("t")).distinct().collect()
    assert [r.t for r in kinds] == [0]
    assert prepared.train.columns == [K.TARGET, "features"]
    assert prepared.train.count() + prepared.test.count() == enriched_regression(spark, SF_SMALL).count()


def test_one_feature_linear_regression_equals_the_aggregate(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    t = enriched_regression(spark, SF_SMALL).select("DepDelay", K.TARGET)
    m = LinearRegression(labelCol=K.TARGET, featuresCol="v", solver="normal").fit(
        VectorAssembler(inputCols=["DepDelay"], outputCol="v").transform(t))
    s = t.agg(F.regr_slope(K.TARGET, "DepDelay"), F.regr_intercept(K.TARGET, "DepDelay")).first()
    assert math.isclose(m.coefficients[0], s[0], rel_tol=1e-9) and math.isclose(m.intercept, s[1], rel_tol=1e-7)


def test_grid_search_by_prefixes_equals_fits_of_each_size(spark, prepared):
    """The error after k iterations of a long fit is that of a fit of k."""
    from pyspark.ml.regression import GBTRegressor
    long = GBTRegressor(labelCol=K.TARGET, maxIter=6, maxDepth=3, seed=42).fit(prepared.train)
    errors = long.evaluateEachIteration(prepared.test, "squared")
    for n in (2, 4):
        short = GBTRegressor(labelCol=K.TARGET, maxIter=n, maxDepth=3, seed=42).fit(prepared.train)
        rmse = M.regression_scores(short.transform(prepared.test))["rmse"]
        assert math.isclose(rmse, errors[n - 1] ** 0.5, rel_tol=1e-9)
    raw = raw_split(spark)[0]
    got = M.tune_gbt(raw, prepared, iters=(2, 4), depths=(2, 3), folds=2)
    # what ran: two depths in two folds, the baseline and the refit
    assert got["fits"] == 6 and got["best_maxIter"] in (2, 4) and got["rmse_tuned"] > 0
    least = min(got["board"], key=lambda r: r[2])
    assert len(got["board"]) == 4 and least[:2] == (got["best_maxIter"], got["best_maxDepth"])


def test_a_broken_model_is_an_error_and_a_missing_one_is_none(tmp_path, spark):
    (tmp_path / "broken" / "metadata").mkdir(parents=True)
    assert M.load_model(str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        M.load_model(str(tmp_path / "broken"))


def test_a_query_fits_the_models_that_it_names(spark, monkeypatch):
    from tardy import catalog as Q
    fitted, real = [], M.train_compare

    def watched(prep, estimators, kind, label=K.TARGET):
        fitted.append((kind, *estimators))
        return real(prep, estimators, kind, label)

    small = M.regressors
    monkeypatch.setattr(M, "train_compare", watched)
    monkeypatch.setattr(M, "regressors", lambda: small(rf_trees=2, rf_depth=2, gbt_iter=2, gbt_depth=2))
    monkeypatch.setattr(Q, "_MEMO", {})
    Q.q_regression_lr(spark, SF_SMALL)
    assert fitted == [("A", "Linear Regression")]
    Q.q_feature_importance(spark, SF_SMALL)
    assert fitted[1:] == [("A", "Random Forest")]
    Q.regression_models(spark, SF_SMALL)
    assert fitted[2:] == [("A", "GBT Regressor"), ("B", "Linear Regression")]
    # the board has every model once, in its place; none is fitted again
    every = Q.regression_fits(spark, SF_SMALL, "A")
    assert [(f.name, f.position) for f in every] == [(n, i) for i, n in enumerate(M.regressors())]
    assert len(fitted) == 4


def test_a_model_table_has_a_few_tasks_per_core():
    assert [M.model_tasks(n, 12) for n in (0, 1, 250_000, 29_000_000, 170_000_000)] == [1, 1, 3, 36, 170]


def rows_of_tasks(df):
    parts = df.groupBy(F.spark_partition_id()).count().collect()
    return [r["count"] for r in parts]


def test_both_parts_of_a_table_in_one_file_are_dealt_over_tasks(spark):
    from tardy import catalog as Q
    from tardy.plans.sizing import materialize
    big = materialize(spark.range(400_000).select("id", (F.col("id") % 7).alias("x")).coalesce(1))
    train, test = Q._written_split(big)
    sizes = rows_of_tasks(train)
    assert len(sizes) > 1 and max(sizes) * len(sizes) <= 2 * sum(sizes)
    assert train.unionByName(test).distinct().count() == train.count() + test.count() == 400_000
    # a few rows stay as they were written
    small = materialize(spark.range(1_000).coalesce(1))
    assert rows_of_tasks(M.dealt(small)) == [1_000] and M.dealt(small) is small
    assert M.dealt(materialize(spark.range(0))).count() == 0


def test_forest_with_kept_nodes_is_the_forest_without(spark):
    rows = M.fill_inputs(regression_model_table(spark, SF_SMALL), K.NUMERIC_FEATURES).withColumn(
        "late", (F.col(K.TARGET) > 30).cast("int"))
    prep = M.prepare(*M.random_split(rows), K.NUMERIC_FEATURES, labels=["late"])
    kept = M.classifier("late", trees=4, depth=6)
    assert kept.getCacheNodeIds()
    plain = kept.copy({kept.cacheNodeIds: False}).fit(prep.train)
    body = [m.toDebugString.split("\n", 1)[1] for m in (kept.fit(prep.train), plain)]
    assert body[0] == body[1]


def test_the_test_rows_are_scored_once(spark, monkeypatch):
    from tardy import catalog as Q
    real = M.classifier
    monkeypatch.setattr(Q, "_MEMO", {})
    monkeypatch.setattr(M, "classifier", lambda label: real(label, trees=3, depth=3))
    answers = Q.q_classification_60(spark, SF_SMALL)
    fit = Q.classification_fit(spark, SF_SMALL, 60)
    files = set(answers.inputFiles())
    assert files and not files & set(fit.prepared.test.inputFiles())
    again = fit.model.transform(fit.prepared.test).select(
        "DelayOver60", "prediction", F.round(M.positive_percent(), 6).alias("probability_pct"))
    assert sorted(answers.collect()) == sorted(again.collect())
    assert fit.metrics == M.classification_scores(fit.model.transform(fit.prepared.test), "DelayOver60")
