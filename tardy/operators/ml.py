"""Delay models with MLlib: feature stages, regression and classification,
leaderboard, tuning, importances, save/load, batch scoring.

Feature stages (indexers, one-hot encoders, assembler, scaler) are fitted
ONCE per feature set and their output (label and feature vector only) is
written; every model of the comparison reads it instead of refitting the same
stages.  The stages of all tuning folds come from one scan.  The indexer and encoder are
multi-column stages, so all five categorical columns are counted in one pass.

The min-max scaler sees the numeric block alone, so that the one-hot slots
stay sparse: scaling a 0/1 slot to [0, 1] changes nothing, except a slot that
is 1 in every row, which stays 1 here and would become 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.session import ensure_checkpoint_dir
from ..plans.sizing import delete_path, materialize, path_exists, scratch_path
from . import metrics as MT
from .boosting import BoostedTrees
from .forests import ForestClassifier, ForestRegressor

FEATURES = "features"
RAW_FEATURES = "features_raw"
NUMERIC_BLOCK, SCALED_BLOCK = "numeric_raw", "numeric_scaled"
# rows of a model table that one task holds: boosting runs hundreds of short
# jobs, whose cost is the number of tasks, so there are no more than a few per
# core until a task would hold too many rows to keep in memory
ROWS_PER_PARTITION, MOST_ROWS_PER_PARTITION, TASKS_PER_CORE = 100_000, 1_000_000, 3


def model_tasks(rows: int, cores: int) -> int:
    """Partitions of a model table of ``rows`` rows."""
    few = min(-(-rows // ROWS_PER_PARTITION), TASKS_PER_CORE * cores)
    return max(1, few, -(-rows // MOST_ROWS_PER_PARTITION))


def dealt(table: DataFrame) -> DataFrame:
    """The rows of a written table, dealt anew if one task would read more
    than twice its share of them: the written files follow those that were
    read, and each row group of a file is one task's, however many rows it
    holds.  (Counted from the footers.)"""
    sizes = [r.n for r in table.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    tasks = model_tasks(sum(sizes), table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(tasks) if max(sizes, default=0) * tasks > 2 * sum(sizes) else table


# ---------------------------------------------------------------- feature stages
def feature_stages(numeric: list[str], categorical: list[str] | None = None,
                   scaler: str = "minmax") -> list:
    categorical = K.CATEGORICAL_FEATURES if categorical is None else categorical
    idx_cols = [f"{c}Index" for c in categorical]
    vec_cols = [f"{c}Vec" for c in categorical]
    indexer = StringIndexer(inputCols=categorical, outputCols=idx_cols,
                            handleInvalid="keep", stringOrderType="frequencyDesc")
    encoder = OneHotEncoder(inputCols=idx_cols, outputCols=vec_cols, dropLast=True)
    if scaler == "standard":  # division only: sparse stays sparse
        assembler = VectorAssembler(inputCols=vec_cols + numeric, outputCol=RAW_FEATURES,
                                    handleInvalid="error")
        scale = StandardScaler(inputCol=RAW_FEATURES, outputCol=FEATURES,
                               withMean=False, withStd=True)
        return [indexer, encoder, assembler, scale]
    block = VectorAssembler(inputCols=numeric, outputCol=NUMERIC_BLOCK, handleInvalid="error")
    scale = MinMaxScaler(inputCol=NUMERIC_BLOCK, outputCol=SCALED_BLOCK)
    assembler = VectorAssembler(inputCols=vec_cols + [SCALED_BLOCK], outputCol=FEATURES,
                                handleInvalid="error")
    return [indexer, encoder, block, scale, assembler]


def fill_inputs(df: DataFrame, numeric: list[str]) -> DataFrame:
    """The policy for null numeric inputs (the assembler rejects them): the
    value that serving assumes for a missing request field, else 0.  No row
    is lost; ``null_inputs`` counts what was filled."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(K.REQUEST_DEFAULTS.get(c, 0)))
                           for c in numeric})


def null_inputs(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(column, nulls) for every numeric input, in one pass."""
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(numeric))
    return (df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(numeric)])
              .selectExpr(f"stack({len(numeric)}, {stack}) as (column, nulls)"))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit(list(weights), seed=seed)
    return train, test


@dataclass
class Prepared:
    """Fitted feature stages and the written (labels, vector) tables."""
    features: PipelineModel
    train: DataFrame
    test: DataFrame
    numeric: list[str]
    root: str = ""

    def release(self):
        """Delete the written tables."""
        delete_path(self.train.sparkSession, self.root)


def prepare(train: DataFrame, test: DataFrame, numeric: list[str], scaler: str = "minmax",
            labels: list[str] | None = None) -> Prepared:
    """Fit the feature stages once on the training rows and write labels and
    vectors of both parts (written tables survive lost executors and are
    read by every model; the raw columns are not carried along).  ``train``
    and ``test`` should read a written table: several passes go over them."""
    spark = train.sparkSession
    labels = [K.TARGET] if labels is None else labels
    train, test = fill_inputs(train, numeric), fill_inputs(test, numeric)
    fm = Pipeline(stages=feature_stages(numeric, scaler=scaler)).fit(train)
    root = scratch_path(spark, "models")
    parts = []
    for name, rows in (("train", train), ("test", test)):
        tasks = model_tasks(rows.count(), spark.sparkContext.defaultParallelism)
        have = fm.transform(rows).select(*labels, FEATURES)
        have.coalesce(tasks).write.parquet(f"{root}/{name}")
        parts.append(spark.read.schema(have.schema).parquet(f"{root}/{name}"))
    return Prepared(fm, *parts, numeric, root)


# ---------------------------------------------------------------- estimators
def regressors(label: str = K.TARGET, lr_iter: int = 100, rf_trees: int = 20,
               rf_depth: int = 10, gbt_iter: int = 100, gbt_depth: int = 7,
               seed: int = 42) -> dict:
    return {
        "Linear Regression": LinearRegression(featuresCol=FEATURES, labelCol=label, maxIter=lr_iter),
        "Random Forest": ForestRegressor(featuresCol=FEATURES, labelCol=label,
                                         numTrees=rf_trees, maxDepth=rf_depth, seed=seed),
        "GBT Regressor": BoostedTrees(featuresCol=FEATURES, labelCol=label, maxIter=gbt_iter,
                                      maxDepth=gbt_depth, seed=seed),
    }


def classifier(label: str, trees: int = 50, depth: int = 10, seed: int = 42):
    """Kept nodes and the checkpoint are for forests that are left to the
    library: each row keeps its node in every tree from level to level, and
    the dozen levels need no checkpoint in between."""
    return ForestClassifier(featuresCol=FEATURES, labelCol=label, numTrees=trees,
                            maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)


def regression_scores(pred: DataFrame, label: str = K.TARGET) -> dict[str, float]:
    """RMSE, MAE and R^2 from one pass over the predictions."""
    r = MT.regression_metrics(pred, label).first()
    return {m: r[m] for m in ("rmse", "mae", "r2")}


def classification_scores(pred: DataFrame, label: str) -> dict[str, float]:
    """Exact AUC and accuracy; the model runs once."""
    scored = pred.select(vector_to_array("probability")[1].alias("score"), label, "prediction")
    r = MT.auc_and_accuracy(scored, "score", label).first()
    return {"auc": r.auc, "accuracy": r.accuracy}


@dataclass
class Fitted:
    name: str
    kind: str
    model: object
    metrics: dict
    position: int
    prepared: Prepared = field(repr=False, default=None)
    scored: DataFrame = field(repr=False, default=None)

    def pipeline(self) -> PipelineModel:
        """Feature stages + model as one servable pipeline."""
        return PipelineModel(stages=list(self.prepared.features.stages) + [self.model])


def train_compare(prep: Prepared, estimators: dict, kind: str,
                  label: str = K.TARGET) -> list[Fitted]:
    ensure_checkpoint_dir(prep.train.sparkSession)

    def fit(job):
        i, (name, est) = job
        # read from the written table: each library trainer keeps its own
        # form of the rows, which a cached table would push out of memory
        model = est.fit(prep.train)
        return Fitted(name, kind, model, regression_scores(model.transform(prep.test), label), i, prep)
    # the models are independent; their many short jobs share the cluster
    with ThreadPoolExecutor(len(estimators)) as pool:
        return list(pool.map(fit, enumerate(estimators.items())))


def leaderboard(spark: SparkSession, fitted: list[Fitted]) -> DataFrame:
    """One row per fitted model (a handful of scalars, built on the driver)."""
    rows = [(f.kind, f.name, f.position, float(f.metrics["rmse"]), float(f.metrics["mae"]),
             float(f.metrics["r2"])) for f in fitted]
    schema = "Type string, Model string, position int, RMSE double, MAE double, R2 double"
    return spark.createDataFrame(rows, schema)


def best_model(board: DataFrame) -> DataFrame:
    """Highest R^2 per model type; the first model wins a tie."""
    best = F.max_by(F.struct("Model", "position", "RMSE", "MAE", "R2"),
                    F.struct(F.col("R2"), -F.col("position")))
    return board.groupBy("Type").agg(best.alias("b")).select("Type", "b.*")


def pick_best(fitted: list[Fitted]) -> Fitted:
    best = None
    for f in fitted:  # strict '>' keeps the first of equal scores
        if best is None or f.metrics["r2"] > best.metrics["r2"]:
            best = f
    return best


# ---------------------------------------------------------------- cross-validation
FOLD = "_fold"
#: columns whose values deal a row to its fold
FOLD_KEYS = [*K.CATEGORICAL_FEATURES, "Day", "DepHour", "Distance", "CRSElapsedTime"]


def with_folds(df: DataFrame, folds: int = 3, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Rows with their fold, from a hash of their values: the same in every
    run, whatever the partitions (equal rows share a fold)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (keys or FOLD_KEYS)])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(FOLD, (number % folds).cast("int"))


def fold_statistics(df: DataFrame, numeric: list[str], categorical: list[str] | None = None) -> list:
    """Per fold the count of every category value and the range of every
    numeric input, from one grouping-sets scan (a row per fold and value)."""
    categorical = K.CATEGORICAL_FEATURES if categorical is None else categorical
    sets = [[FOLD, c] for c in categorical] + [[FOLD]]
    spread = [f(c).alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupingSets(sets, FOLD, *categorical).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"), *spread).collect()


def fold_stages(train: DataFrame, statistics: list, held: int, numeric: list[str],
                categorical: list[str] | None = None) -> PipelineModel:
    """The feature stages of one fold, put together from the statistics of
    the other folds: the rows of fold ``held`` have no part in them.
    ``train`` is only asked for its columns."""
    categorical = K.CATEGORICAL_FEATURES if categorical is None else categorical
    spark, width = train.sparkSession, len(categorical) + 1
    indexer, encoder, block, scale, assembler = feature_stages(numeric, categorical)
    others = [r for r in statistics if r[FOLD] != held]
    labels = []
    for i, c in enumerate(categorical):
        gid = (1 << width) - 1 - (1 << (width - 1)) - (1 << (width - 2 - i))
        counts: dict[str, int] = {}
        for r in others:
            if r["gid"] == gid and r[c] is not None:
                counts[r[c]] = counts.get(r[c], 0) + r["n"]
        labels.append(sorted(counts, key=lambda v: (-counts[v], v)))
    index = [StringIndexerModel.from_labels(v, a, b, handleInvalid="keep")
             for v, a, b in zip(labels, indexer.getInputCols(), indexer.getOutputCols())]
    whole = [r for r in others if r["gid"] == (1 << (width - 1)) - 1]
    ranges = [Vectors.dense([float(pick(r[f"{n}{i}"] for r in whole)) for i in range(len(numeric))])
              for n, pick in (("lo", min), ("hi", max))]
    # the encoder reads the index's labels, the scaler two rows: its ends
    encode = encoder.fit(PipelineModel(stages=index).transform(train.select(*categorical)))
    ends = spark.createDataFrame([(r,) for r in ranges], [NUMERIC_BLOCK])
    return PipelineModel(stages=[*index, encode, block, scale.fit(ends), assembler])


def tune_gbt(train: DataFrame, prep: Prepared, label: str = K.TARGET, iters=(20, 50, 100), depths=(4, 6),
             folds: int = 3, seed: int = 42, parallelism: int = 3) -> dict:
    """Default boosted trees vs a cross-validated grid over the whole
    pipeline: each fold has feature stages of its own, from the other folds
    only.  ``train`` holds the raw training rows, ``prep`` the stages fitted
    on all of them and the test rows.  Returns baseline/tuned RMSE, the best
    parameters, the board of the grid and the number of fits that ran.

    Boosting with the same seed builds the same first trees whatever the
    number of iterations, so one fit of the largest number per fold and
    depth serves every grid point of that depth: its error after each
    iteration comes from one pass over the fold's validation rows.
    """
    ensure_checkpoint_dir(train.sparkSession)
    gbt = BoostedTrees(featuresCol=FEATURES, labelCol=label, seed=seed)
    ran = [0]

    def fitted(depth: int, n: int, rows: DataFrame):
        ran[0] += 1
        return gbt.copy({gbt.maxIter: n, gbt.maxDepth: depth}).fit(rows)

    base = fitted(gbt.getMaxDepth(), gbt.getMaxIter(), prep.train)
    rmse_base = regression_scores(base.transform(prep.test), label)["rmse"]
    rows = with_folds(fill_inputs(train, prep.numeric), folds, seed)
    statistics = fold_statistics(rows, prep.numeric)
    tables = {}
    for k in range(folds):
        stages = fold_stages(rows, statistics, k, prep.numeric)
        ready = materialize(stages.transform(rows).select(FOLD, label, FEATURES))
        tables[k] = ready.filter(F.col(FOLD) != k), ready.filter(F.col(FOLD) == k)

    def fit(job):
        depth, k = job
        learn, check = tables[k]
        errors = fitted(depth, max(iters), learn).evaluateEachIteration(check, "squared")
        return [(depth, n, errors[n - 1] ** 0.5) for n in iters]

    jobs = [(d, k) for d in depths for k in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = [r for rs in pool.map(fit, jobs) for r in rs]
    mean = {(n, d): sum(e for dd, nn, e in found if (nn, dd) == (n, d)) / folds
            for n in iters for d in depths}
    best_iter, best_depth = min(mean, key=mean.get)  # the first of equal points
    best = fitted(best_depth, best_iter, prep.train)
    rmse_tuned = regression_scores(best.transform(prep.test), label)["rmse"]
    return {"rmse_baseline": rmse_base, "rmse_tuned": rmse_tuned,
            "gain": rmse_base - rmse_tuned,
            "gain_pct": (1 - rmse_tuned / rmse_base) * 100 if rmse_base else None,
            "best_maxIter": best_iter, "best_maxDepth": best_depth,
            "fits": ran[0], "board": [(n, d, e) for (n, d), e in mean.items()]}


def tuning_frame(spark: SparkSession, result: dict) -> DataFrame:
    schema = ("rmse_baseline double, rmse_tuned double, gain double, gain_pct double, "
              "best_maxIter int, best_maxDepth int, fits int")
    keys = ["rmse_baseline", "rmse_tuned", "gain", "gain_pct", "best_maxIter", "best_maxDepth", "fits"]
    return spark.createDataFrame([tuple(result[k] for k in keys)], schema)


# ---------------------------------------------------------------- importances
def feature_names(df: DataFrame, numeric: list[str], column: str = FEATURES) -> list[str]:
    """Slot names from the assembler's attribute metadata; the slots of the
    scaled block are the numeric columns in order."""
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = [a for group in attrs.values() for a in group]
    names = [""] * (max(a["idx"] for a in slots) + 1)
    for a in slots:
        name = a["name"]
        block = name.removeprefix(f"{SCALED_BLOCK}_")
        names[a["idx"]] = numeric[int(block)] if block != name else name
    return names


def _source_of(slot: str, categorical: list[str]) -> str:
    for c in categorical:
        if slot.startswith(f"{c}Vec"):
            return c
    return slot


def feature_importance(spark: SparkSession, model, names: list[str], top: int = 20,
                       rollup: bool = True) -> DataFrame:
    """Importance per slot, optionally summed per source column, top-k."""
    imp = model.featureImportances.toArray()
    rows = [(n, _source_of(n, K.CATEGORICAL_FEATURES), float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "slot string, Feature string, Importance double")
    if rollup:
        df = df.groupBy("Feature").agg(F.sum("Importance").alias("Importance"))
    else:
        df = df.select(F.col("slot").alias("Feature"), "Importance")
    return df.orderBy(F.desc("Importance"), "Feature").limit(top)


# ---------------------------------------------------------------- save / load
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """A missing model loads as None (scoring then answers with error rows);
    any other fault is raised."""
    if not path_exists(SparkSession.builder.getOrCreate(), path):
        return None
    return PipelineModel.load(path)


# ---------------------------------------------------------------- scoring
_ML_COLS = ["rawPrediction", "probability", "prediction", RAW_FEATURES, FEATURES, NUMERIC_BLOCK,
            SCALED_BLOCK]


def _drop_ml(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c in _ML_COLS or c.endswith("Index") or c.endswith("Vec")]
    return df.drop(*extra)


def _error_rows(df: DataFrame, message: str, cols: list[tuple[str, str]]) -> DataFrame:
    return df.select("request_id", *[F.lit(None).cast(t).alias(c) for c, t in cols],
                     F.lit("error").alias("status"), F.lit(message).alias("error"))


def _finite(column: str) -> F.Column:
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_features(numeric: list[str]) -> F.Column:
    """True when every numeric input is present and finite.  A row failing
    it would make the assembler fail the whole batch / micro-batch."""
    ok = F.lit(True)
    for c in numeric:
        ok = ok & _finite(c)
    return ok


def _neutral(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Non-finite inputs as 0, so every row passes the assembler; the row's
    validity is known from before."""
    return df.withColumns({c: F.when(_finite(c), F.col(c)).otherwise(F.lit(0)) for c in numeric})


def score_regression(features: DataFrame, model_a: PipelineModel | None,
                     model_b: PipelineModel | None) -> DataFrame:
    """model_type B -> model B (adds DepDelay, TaxiOut); anything else -> A.
    Rows whose inputs are not finite answer with an error row; the rest of
    the batch is scored.  One pass: both models run in a chain over neutral
    inputs and each row takes the prediction of its own."""
    cols = [("predicted_delay_minutes", "double"), ("model_type", "string")]
    if model_a is None or model_b is None:
        return _error_rows(features, "Regression models not loaded", cols)
    is_b = F.coalesce(F.col("model_type") == K.MODEL_B, F.lit(False))
    rows = features.withColumn("_b", is_b).withColumn(
        "_ok", F.when(F.col("_b"), finite_features(K.NUMERIC_FEATURES_WITH_DEP))
                .otherwise(finite_features(K.NUMERIC_FEATURES)))
    rows = _neutral(rows, K.NUMERIC_FEATURES_WITH_DEP)
    rows = _drop_ml(model_b.transform(rows).withColumn("_pb", F.col("prediction")))
    rows = model_a.transform(rows)
    picked = F.round(F.when(F.col("_b"), F.col("_pb")).otherwise(F.col("prediction")), 2)
    return rows.select(
        "request_id", F.when(F.col("_ok"), picked).alias("predicted_delay_minutes"), "model_type",
        F.when(F.col("_ok"), "success").otherwise("error").alias("status"),
        F.when(~F.col("_ok"), "invalid feature value").alias("error"))


def positive_percent(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col)).getItem(1) * 100


def score_classification(features: DataFrame, model_30: PipelineModel | None,
                         model_60: PipelineModel | None) -> DataFrame:
    cols = [("probability_over_30min", "double"), ("probability_over_60min", "double")]
    if model_30 is None or model_60 is None:
        return _error_rows(features, "Classification models not loaded", cols)
    rows = _neutral(features.withColumn("_ok", finite_features(K.NUMERIC_FEATURES)), K.NUMERIC_FEATURES)
    rows = _drop_ml(model_30.transform(rows).withColumn("_p30", positive_percent()))
    rows = model_60.transform(rows).withColumn("_p60", positive_percent())
    ok = F.col("_ok")
    return rows.select(
        "request_id", F.when(ok, F.round("_p30", 1)).alias("probability_over_30min"),
        F.when(ok, F.round("_p60", 1)).alias("probability_over_60min"),
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(~ok, "invalid feature value").alias("error"))


def with_residuals(pred: DataFrame, label: str = K.TARGET) -> DataFrame:
    return pred.select(label, "prediction", (F.col(label) - F.col("prediction")).alias("Residual"))

