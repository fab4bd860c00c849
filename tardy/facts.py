"""Facts about random and learned results that do not depend on a seed.

Sampled rows, splits, fitted models and their answers cannot be restated in
SQL value by value; what must hold for every seed can: nothing lost or made
up, one answer per request, metrics equal to their definition, importances
that sum to one, streams equal to tables.  Each query computes such facts
from the whole result, and ``FACT_ORACLE`` states them from the raw tables.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as Q
from . import oracle as O
from .catalog import register
from .functions import constants as K
from .operators import ml as M

FACT_ORACLE: dict[str, str] = {}


def _equal(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(rows, equal_rows) of a full comparison on unique keys."""
    right = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(v).alias(f"r_{v}") for v in values],
                     F.lit(True).alias("r_here"))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    joined = a.withColumn("l_here", F.lit(True)).join(right, on, "full")
    same = F.col("l_here") & F.col("r_here")
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"r_{v}"))
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("equal_rows"))


def _share_between(part: str, whole: str, low: float, high: float):
    return (F.col(part) >= F.col(whole) * low) & (F.col(part) <= F.col(whole) * high)


# ---------------------------------------------------------------- samples and splits
@register("sample_facts")
def q_sample_facts(spark, sf):
    """A tenth of the rows, and only values that the table has."""
    whole = Q._eda(spark, sf).select("ArrDelay")
    part = Q.q_sample_bernoulli(spark, sf)
    known = part.groupBy("ArrDelay").agg(F.count(F.lit(1)).alias("c")).join(
        whole.groupBy("ArrDelay").agg(F.count(F.lit(1)).alias("n")), "ArrDelay", "left")
    sums = known.agg(F.sum("c").alias("sampled"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("c")).alias("unknown"))
    n = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sums.withColumn("n", n).select("n", "unknown", _share_between("sampled", "n", 0.05, 0.15).alias("a_tenth"))


FACT_ORACLE["sample_facts"] = O.BASE + "SELECT count(*) AS n, cast(0 AS BIGINT) AS unknown, true AS a_tenth FROM eda"


@register("capped_sample_facts")
def q_capped_sample_facts(spark, sf):
    """Exactly the cap (or the table), whatever the partitions: the sample of
    the same rows dealt to other partitions is the same."""
    from .operators.sampling import capped_sample
    cols = ["Distance", "ArrDelay"]
    rows = Q._eda(spark, sf).select(*cols)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    a, b = capped_sample(rows, 700), capped_sample(rows.repartition(13), 700)
    other = a.exceptAll(b).agg(F.count(F.lit(1)).alias("k")).scalar()
    return a.agg(F.count(F.lit(1)).alias("k")).select("k", n.alias("n"), other.alias("differing"))


FACT_ORACLE["capped_sample_facts"] = O.BASE + (
    "SELECT least(count(*), 700) AS k, count(*) AS n, cast(0 AS BIGINT) AS differing FROM eda")


@register("random_split_facts")
def q_random_split_facts(spark, sf):
    """Both parts together are the table; the training part has about 0.8."""
    parts = Q.q_random_split(spark, sf).groupBy("UniqueCarrier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ArrDelay").alias("delay"), F.count_if(F.col("split") == "train").alias("t"))
    return parts.select("UniqueCarrier", "n", "delay", _share_between("t", "n", 0.65, 0.95).alias("most_train"))


FACT_ORACLE["random_split_facts"] = O.BASE + """
SELECT UniqueCarrier, count(*) AS n, sum(ArrDelay) AS delay, true AS most_train FROM reg GROUP BY UniqueCarrier"""


@register("first_rows_facts")
def q_first_rows_facts(spark, sf):
    """Five rows, all of them in the table."""
    t = Q.flights_view(spark, sf)
    rows = Q.q_first_rows(spark, sf).withColumn("h", F.xxhash64(*t.columns))
    known = t.select(F.xxhash64(*t.columns).alias("h")).distinct()
    return rows.join(known, "h", "left_semi").agg(F.count(F.lit(1)).alias("n_found"))


FACT_ORACLE["first_rows_facts"] = "SELECT least(count(*), 5) AS n_found FROM lineitem"


@register("summary_facts")
def q_summary_facts(spark, sf):
    """The exact rows of ``summary()`` as numbers."""
    cols = K.SUMMARY_COLUMNS
    t = Q.q_summary_table(spark, sf).filter(F.col("summary").isin("count", "mean", "stddev", "min", "max"))
    return t.select("summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in cols])


FACT_ORACLE["summary_facts"] = O.BASE + " UNION ALL ".join(
    f"SELECT '{name}' AS summary, " + ", ".join(f"round(cast({fn}({c}) AS DOUBLE), 6) AS {c}" for c in K.SUMMARY_COLUMNS)
    + " FROM eda" for name, fn in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"),
                                   ("max", "max")))


# ---------------------------------------------------------------- models
def _all_fits(spark, sf) -> list:
    return Q.regression_fits(spark, sf, "A") + Q.regression_fits(spark, sf, "B")


@register("leaderboard_facts")
def q_leaderboard_facts(spark, sf):
    """Every model is on the board with metrics equal to the library
    evaluator's; with the departure delay (type B) it beats the mean."""
    board = {(r.Type, r.Model): r for r in Q.q_model_leaderboard(spark, sf).collect()}
    rows = []
    for f in _all_fits(spark, sf):
        pred = f.model.transform(f.prepared.test)
        ev = RegressionEvaluator(labelCol=K.TARGET, predictionCol="prediction")
        r = board[(f.kind, f.name)]
        same = all(abs(ev.evaluate(pred, {ev.metricName: m}) - r[m.upper()]) <= 1e-6 * max(1, abs(r[m.upper()]))
                   for m in ("rmse", "mae", "r2"))
        rows.append((f.kind, f.name, f.position, same, f.kind == "A" or r.R2 > 0))
    return spark.createDataFrame(rows, "Type string, Model string, position int, equals_evaluator boolean, "
                                       "beats_mean boolean")


_MODELS = [(k, m, i) for k in "AB" for i, m in enumerate(("Linear Regression", "Random Forest", "GBT Regressor"))]
FACT_ORACLE["leaderboard_facts"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{m}', {i}, true, true)" for k, m, i in _MODELS) + ") t(Type, Model, position, equals_evaluator, beats_mean)"


@register("best_model_facts")
def q_best_model_facts(spark, sf):
    """The chosen model of each type has the largest R2."""
    board = Q.q_model_leaderboard(spark, sf).groupBy("Type").agg(F.max("R2").alias("top"))
    return Q.q_best_model(spark, sf).join(board, "Type").select("Type", (F.col("R2") == F.col("top")).alias("is_max"))


FACT_ORACLE["best_model_facts"] = "SELECT * FROM (VALUES ('A', true), ('B', true)) t(Type, is_max)"


@register("prediction_facts")
def q_prediction_facts(spark, sf):
    """Training and test rows together are all rows; every test row has a
    finite prediction of each model."""
    prep = Q.regression_prepared(spark, sf, "A")
    trained = prep.train.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = None
    for name, q in (("Linear Regression", Q.q_regression_lr), ("Random Forest", Q.q_regression_rf),
                    ("GBT Regressor", Q.q_regression_gbt)):
        finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
        one = q(spark, sf).agg((F.count(F.lit(1)) + trained).alias("n"), F.count_if(~finite).alias("not_finite")) \
            .select(F.lit(name).alias("Model"), "n", "not_finite")
        out = one if out is None else out.unionByName(one)
    return out


FACT_ORACLE["prediction_facts"] = O.BASE + " UNION ALL ".join(
    f"SELECT '{m}' AS Model, count(*) AS n, cast(0 AS BIGINT) AS not_finite FROM reg"
    for m in ("Linear Regression", "Random Forest", "GBT Regressor"))


@register("residual_sample_facts")
def q_residual_sample_facts(spark, sf):
    """Residuals are label minus prediction, for a few per cent of the test rows."""
    r = Q.q_residuals_sample(spark, sf)
    n = Q.regression_prepared(spark, sf, "A").test.agg(F.count(F.lit(1)).alias("n")).scalar()
    wrong = F.count_if(F.col("Residual") != F.col(K.TARGET) - F.col("prediction")).alias("wrong")
    return r.agg(F.count(F.lit(1)).alias("k"), wrong).withColumn("n", n).select(
        "wrong", (F.col("k") <= F.col("n") * 0.1 + 10).alias("few"))


FACT_ORACLE["residual_sample_facts"] = "SELECT cast(0 AS BIGINT) AS wrong, true AS few"


@register("tuning_facts")
def q_tuning_facts(spark, sf):
    """What ran and what came of it: six grid fits, the refit and the
    baseline; every grid point has an error; the best point is the smallest
    one of the board; both final errors are below that of the mean."""
    t, board = Q.q_tune_gbt(spark, sf), Q.q_tuning_board(spark, sf)
    best = board.agg(F.min_by(F.struct("maxIter", "maxDepth"), F.struct("rmse", "maxDepth", "maxIter")).alias("b"),
                     F.count_if(F.col("rmse") > 0).alias("points")).first()
    test = Q.regression_prepared(spark, sf, "A").test
    spread = test.agg(F.stddev_pop(K.TARGET).alias("s")).scalar()
    return t.select(
        "fits", F.lit(best.points).alias("points"),
        ((F.col("best_maxIter") == best.b.maxIter) & (F.col("best_maxDepth") == best.b.maxDepth)).alias("is_least"),
        (F.abs(F.col("rmse_baseline") - F.col("rmse_tuned") - F.col("gain")) < 1e-9).alias("gain_holds"),
        ((F.col("rmse_tuned") < spread * 1.1) & (F.col("rmse_baseline") < spread * 1.1)).alias("near_or_below_mean"))


FACT_ORACLE["tuning_facts"] = ("SELECT 8 AS fits, cast(6 AS BIGINT) AS points, true AS is_least, true AS gain_holds, "
                               "true AS near_or_below_mean")


@register("importance_facts")
def q_importance_facts(spark, sf):
    """Importances of the forest: none negative, all together one, at most 20."""
    f = Q.regression_fit(spark, sf, "A", "Random Forest")
    names = M.feature_names(f.prepared.train, f.prepared.numeric)
    every = M.feature_importance(spark, f.model, names, top=len(names))
    top = Q.q_feature_importance(spark, sf).agg(F.count(F.lit(1)).alias("k")).scalar()
    return every.agg(F.round(F.sum("Importance"), 9).alias("total"), F.count_if(F.col("Importance") < 0).alias("negative"),
                     F.count(F.lit(1)).alias("sources")).withColumn("top_rows", top)


FACT_ORACLE["importance_facts"] = (
    f"SELECT cast(1 AS DOUBLE) AS total, cast(0 AS BIGINT) AS negative, cast({len(K.NUMERIC_FEATURES) + 5} AS BIGINT) "
    f"AS sources, cast(20 AS BIGINT) AS top_rows")


@register("classification_facts")
def q_classification_facts(spark, sf):
    """Rows of both parts, probabilities in range, metrics equal to their
    definition on the predictions."""
    prep = Q.classification_prepared(spark, sf)
    n = prep.train.count() + prep.test.count()
    board = {r.label: r for r in Q.q_classification_metrics(spark, sf).collect()}
    rows = []
    for t, q in ((30, Q.q_classification_30), (60, Q.q_classification_60)):
        label = f"DelayOver{t}"
        p = q(spark, sf)
        s = p.agg(F.count_if(~F.col("probability_pct").between(0, 100)).alias("bad"),
                  F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("acc")).first()
        fit = Q.classification_fit(spark, sf, t)
        area = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0) \
            .evaluate(fit.model.transform(prep.test))
        rows.append((label, n, s.bad, abs(s.acc - board[label].accuracy) < 1e-9, abs(area - board[label].auc) < 1e-3))
    return spark.createDataFrame(rows, "label string, n long, out_of_range long, accuracy_holds boolean, "
                                       "auc_holds boolean")


FACT_ORACLE["classification_facts"] = O.CLASSIFICATION + " UNION ALL ".join(
    f"SELECT 'DelayOver{t}' AS label, count(*) AS n, cast(0 AS BIGINT) AS out_of_range, true AS accuracy_holds, "
    f"true AS auc_holds FROM cls" for t in (30, 60))


@register("classification_sample_facts")
def q_classification_sample_facts(spark, sf):
    """Ten rows, each with the class that its probability implies."""
    s = Q.q_classification_sample(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        (F.col("prediction") == 1) != (F.col("probability_pct") > 50)).alias("wrong"))


FACT_ORACLE["classification_sample_facts"] = "SELECT cast(10 AS BIGINT) AS n, cast(0 AS BIGINT) AS wrong"


# ---------------------------------------------------------------- scoring and streams
@register("score_regression_facts")
def q_score_regression_facts(spark, sf):
    """One rounded answer for every valid request."""
    s, x = Q.q_score_regression(spark, sf), F.col("predicted_delay_minutes")
    return s.select("request_id", "model_type", "status", (F.round(x, 2) == x).alias("rounded"), "error")


FACT_ORACLE["score_regression_facts"] = O.SERVE + """
SELECT request_id, coalesce(model_type, 'A') AS model_type, 'success' AS status, true AS rounded,
  cast(NULL AS VARCHAR) AS error FROM vreq"""


@register("score_classification_facts")
def q_score_classification_facts(spark, sf):
    s = Q.q_score_classification(spark, sf)
    a, b = F.col("probability_over_30min"), F.col("probability_over_60min")
    ok = a.between(0, 100) & b.between(0, 100) & (F.round(a, 1) == a) & (F.round(b, 1) == b)
    return s.select("request_id", "status", ok.alias("in_range"), "error")


FACT_ORACLE["score_classification_facts"] = O.SERVE + """
SELECT request_id, 'success' AS status, true AS in_range, cast(NULL AS VARCHAR) AS error FROM vreq"""


@register("stream_score_facts")
def q_stream_score_facts(spark, sf):
    """Streams answer as the tables do, request by request."""
    out = None
    for kind, stream, batch, values in (
            ("regression", Q.q_stream_score_regression, Q.q_score_regression,
             ["predicted_delay_minutes", "model_type", "status"]),
            ("classification", Q.q_stream_score_classification, Q.q_score_classification,
             ["probability_over_30min", "probability_over_60min", "status"])):
        one = _equal(stream(spark, sf), batch(spark, sf), ["request_id"], values).select(
            F.lit(kind).alias("kind"), "rows", "equal_rows")
        out = one if out is None else out.unionByName(one)
    return out


FACT_ORACLE["stream_score_facts"] = O.SERVE + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS rows, count(*) AS equal_rows FROM vreq" for k in ("regression", "classification"))


@register("fan_out_facts")
def q_fan_out_facts(spark, sf):
    """Every message of both topics, decoded."""
    from .sources.schemas import REQUEST_SCHEMA
    m = F.from_json("value", REQUEST_SCHEMA)
    return Q.q_stream_fan_out(spark, sf).select("topic", (F.col("key") == m["request_id"]).alias("keyed"), m.alias("m")) \
        .select("topic", "keyed", "m.*")


FACT_ORACLE["fan_out_facts"] = O.SERVE + """
SELECT topic, true AS keyed, v.* EXCLUDE (ts) FROM vreq v,
  (VALUES ('input-regression'), ('input-classification')) t(topic)"""


@register("request_id_facts")
def q_request_id_facts(spark, sf):
    """Every submission has a UUID of its own."""
    from pyspark.sql import Window
    t = Q.q_request_ids(spark, sf)
    uuid = F.col("request_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return t.select("dep_time", "duration_text", uuid.alias("is_uuid"),
                    F.count(F.lit(1)).over(Window.partitionBy("request_id")).alias("with_this_id"))


FACT_ORACLE["request_id_facts"] = O.SERVE + """
SELECT dep_time, duration_text, true AS is_uuid, cast(1 AS BIGINT) AS with_this_id FROM form"""
