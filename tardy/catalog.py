"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the whole test tables (through the derived views) and
returns a DataFrame; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .functions import features as X
from .operators import clean as C
from .operators import distribution as D
from .operators import enrich as J
from .operators import explore as E
from .operators.indexing import category_index, with_indices
from .operators import stats as S
from .sources.flights import flights_view

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def portable(df: DataFrame) -> DataFrame:
    """Date columns as ISO text at the query boundary (engines hand dates
    to clients differently); values are unchanged."""
    from pyspark.sql import types as T
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields
                           if isinstance(f.dataType, T.DateType)})


def _eda(spark, sf):
    return C.clean_eda(flights_view(spark, sf))


def _reg(spark, sf):
    return C.clean_regression(flights_view(spark, sf))


def _needed(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Only ``columns`` (all by default) and what the statistics read."""
    if columns is None:
        return df
    return df.select([c for c in df.columns if c in {*columns, *S.STAT_KEYS, K.TARGET}])


def enriched_regression(spark, sf, columns: list[str] | None = None) -> DataFrame:
    return J.enrich_all(_needed(_reg(spark, sf), columns))


def classification_table(spark, sf, columns: list[str] | None = None) -> DataFrame:
    """Statistics over status-filtered rows (null delays counted), labels,
    then the late null drop."""
    base = C.clean_classification_base(flights_view(spark, sf))
    out = J.enrich_all(_needed(base, columns)).withColumns(
        {f"DelayOver{t}": X.delay_label(t) for t in K.LABEL_THRESHOLDS})
    return out.dropna(subset=["ArrDelay", "UniqueCarrier", "Origin", "Dest"])


def labelled_flights(spark, sf) -> DataFrame:
    """Labels and null drop of the classification table without its
    statistics."""
    base = C.clean_classification_base(flights_view(spark, sf))
    out = base.withColumns({f"DelayOver{t}": X.delay_label(t) for t in K.LABEL_THRESHOLDS})
    return out.dropna(subset=["ArrDelay", "UniqueCarrier", "Origin", "Dest"])


# ---------------------------------------------------------------- sources / projections
@register("project")
def q_project(spark, sf):
    return flights_view(spark, sf).select("UniqueCarrier", "Origin", "Dest", "ArrDelay")


@register("project_existing")
def q_project_existing(spark, sf):
    return C.project_existing(_eda(spark, sf), K.SUMMARY_COLUMNS + ["NoSuchColumn"])


@register("numeric_columns")
def q_numeric_columns(spark, sf):
    df = _eda(spark, sf)
    return df.select(E.numeric_columns(df))


@register("cast_numeric")
def q_cast_numeric(spark, sf):
    return C.cast_numeric(C.clean_flights(flights_view(spark, sf)))


# ---------------------------------------------------------------- cleaning
@register("clean_flights")
def q_clean_flights(spark, sf):
    return C.clean_flights(flights_view(spark, sf))


@register("clean_eda")
def q_clean_eda(spark, sf):
    return _eda(spark, sf)


@register("clean_regression")
def q_clean_regression(spark, sf):
    return portable(_reg(spark, sf))


@register("clean_classification")
def q_clean_classification(spark, sf):
    return portable(classification_table(spark, sf))


@register("row_counts")
def q_row_counts(spark, sf):
    return E.row_counts(flights_view(spark, sf))


@register("range_filter")
def q_range_filter(spark, sf):
    return E.range_filter(_eda(spark, sf)).select("UniqueCarrier", "ArrDelay")


# ---------------------------------------------------------------- derived columns
@register("derive_features")
def q_derive_features(spark, sf):
    return (X.with_calendar_and_time(C.clean_flights(flights_view(spark, sf)))
            .select("DepTime", "ArrTime", "CRSArrTime", "DepHour", "ArrHour", "CRSArrHour",
                    "IsWeekend", "TaxiTotal", "ScheduledFlightTime", "ActualFlightTime",
                    "FlightTimeDiff"))


@register("calendar_parts")
def q_calendar_parts(spark, sf):
    f = flights_view(spark, sf)
    return portable(f.select(F.col("Date").alias("DateText"), X.parse_date("Date").alias("Date"),
                             F.month(X.parse_date("Date")).alias("Month"),
                             F.dayofmonth(X.parse_date("Date")).alias("Day")))


@register("time_of_day")
def q_time_of_day(spark, sf):
    f = flights_view(spark, sf).withColumn("DepHour", X.hour_of("DepTime"))
    return f.select("DepHour", X.time_of_day("DepHour").alias("TimeOfDay"),
                    X.is_rush_hour("DepHour").alias("IsRushHour"),
                    X.is_weekend("DayOfWeek").alias("IsWeekend"))


@register("distance_band")
def q_distance_band(spark, sf):
    return flights_view(spark, sf).select(
        "Distance", X.distance_category("Distance").alias("DistanceCategory"))


@register("route_key")
def q_route_key(spark, sf):
    return flights_view(spark, sf).select(
        "Origin", "Dest", X.route_key().alias("Route"),
        X.route_key_strict().alias("RouteStrict"))


@register("speed")
def q_speed(spark, sf):
    return E.speed(_eda(spark, sf))


@register("delay_labels")
def q_delay_labels(spark, sf):
    return C.clean_flights(flights_view(spark, sf)).select(
        "ArrDelay", *[X.delay_label(t).alias(f"DelayOver{t}") for t in K.LABEL_THRESHOLDS])


# ---------------------------------------------------------------- statistics + enrichment
for _spec in S.STAT_SPECS:
    def _mk(spec):
        def q(spark, sf):
            return S.single_stat(_reg(spark, sf), spec)
        return q
    register(_spec.name)(_mk(_spec))


@register("all_stats_grouping_sets")
def q_all_stats(spark, sf):
    return S.all_stats_long(_reg(spark, sf))


for _name in J.ENRICH_ORDER:
    def _mk_enrich(name):
        def q(spark, sf):
            spec = S.SPEC_BY_NAME[name]
            out = J.enrich_single(_reg(spark, sf), name)
            return out.select("Origin", "Dest", "UniqueCarrier", "DepHour", "ArrDelay",
                              *[c for c in (spec.avg_col, spec.count_col) if c])
        return q
    register("enrich_" + _name.replace("_stats", ""))(_mk_enrich(_name))


@register("enriched_flights")
def q_enriched_flights(spark, sf):
    return portable(enriched_regression(spark, sf))


@register("carrier_hour_key")
def q_carrier_hour_key(spark, sf):
    """Carrier x hour statistic with its composite text key (the joins use
    the two columns; the key is kept for lookups by text)."""
    t = S.single_stat(_reg(spark, sf), S.SPEC_BY_NAME["carrier_hour_stats"])
    return t.withColumn("Key", F.concat_ws("_", "UniqueCarrier", F.col("DepHour").cast("string")))


@register("route_distances")
def q_route_distances(spark, sf):
    return S.route_distances(flights_view(spark, sf))


@register("distinct_routes")
def q_distinct_routes(spark, sf):
    return S.distinct_routes(flights_view(spark, sf))


# ---------------------------------------------------------------- exploration
@register("delay_by_carrier")
def q_delay_by_carrier(spark, sf):
    return E.delay_by_carrier(_eda(spark, sf))


@register("delay_by_hour")
def q_delay_by_hour(spark, sf):
    return E.delay_by_hour(_eda(spark, sf))


@register("delay_by_day")
def q_delay_by_day(spark, sf):
    return E.delay_by_day(_eda(spark, sf))


@register("delay_by_day_named")
def q_delay_by_day_named(spark, sf):
    return E.delay_by_day_named(_eda(spark, sf))


@register("delay_day_hour")
def q_delay_day_hour(spark, sf):
    return E.delay_day_hour(_eda(spark, sf))


@register("pivot_day_hour")
def q_pivot_day_hour(spark, sf):
    return E.pivot_day_hour(_eda(spark, sf))


@register("top_routes")
def q_top_routes(spark, sf):
    return E.top_routes(_eda(spark, sf))


@register("top_taxi_out")
def q_top_taxi_out(spark, sf):
    return E.top_taxi_out(_eda(spark, sf))


@register("label_balance")
def q_label_balance(spark, sf):
    return E.label_balance(labelled_flights(spark, sf))


@register("summary_stats")
def q_summary_stats(spark, sf):
    return E.summary_stats(_eda(spark, sf)).withColumn("stddev", F.round("stddev", 6))


@register("summary_table")
def q_summary_table(spark, sf):
    """``DataFrame.summary()`` as a user calls it (count, mean, stddev, min,
    approximate 25/50/75 %, max; values as text).  ``summary_stats`` is the
    exact, typed form."""
    return C.project_existing(_eda(spark, sf), K.SUMMARY_COLUMNS).summary()


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return E.correlation_matrix(_eda(spark, sf)).withColumn("corr", F.round("corr", 6))


@register("speed_trend")
def q_speed_trend(spark, sf):
    t = E.speed_trend(_eda(spark, sf))
    return t.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


@register("value_range")
def q_value_range(spark, sf):
    return E.value_range(_eda(spark, sf))


@register("late_share")
def q_late_share(spark, sf):
    return E.late_share(_eda(spark, sf)).withColumn("late_share", F.round("late_share", 9))


@register("union_tagged")
def q_union_tagged(spark, sf):
    return E.union_tagged(_reg(spark, sf))


@register("histogram")
def q_histogram(spark, sf):
    return D.histograms(_eda(spark, sf), ["ArrDelay", "DepDelay"], 50)


@register("density_histogram")
def q_density_histogram(spark, sf):
    return D.density_histogram(_eda(spark, sf), "ArrDelay", 100).withColumn(
        "density", F.round("density", 9))


@register("kde_curve")
def q_kde_curve(spark, sf):
    k = D.kde_curve(_eda(spark, sf), "ArrDelay", 100)
    return k.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@register("box_stats")
def q_box_stats(spark, sf):
    return D.box_stats(_eda(spark, sf), "ArrDelay")


@register("box_stats_by_carrier")
def q_box_stats_by_carrier(spark, sf):
    return D.box_stats(_eda(spark, sf), "ArrDelay", group="UniqueCarrier",
                       lo_keep=-30, hi_keep=180)


# ---------------------------------------------------------------- serving (batch twins)
from .operators import serving as V  # noqa: E402
from .sources import requests as R  # noqa: E402


def serving_stats(spark, sf):
    """The six statistics of the training table, written and size-checked for
    broadcast."""
    return S.compute_stats(_reg(spark, sf))


@register("valid_requests")
def q_valid_requests(spark, sf):
    return V.valid_requests(R.requests_view(spark, sf)).drop("ts")


@register("request_features")
def q_request_features(spark, sf):
    return V.request_features(R.requests_view(spark, sf), serving_stats(spark, sf))


@register("distance_lookup")
def q_distance_lookup(spark, sf):
    from .plans.sizing import bounded_broadcast
    req = V.valid_requests(R.requests_view(spark, sf)).select("request_id", "Origin", "Dest")
    # one row per route: written, broadcast only below the byte bound
    dist = bounded_broadcast(S.route_distances(flights_view(spark, sf)))
    return V.distance_lookup(req, dist)


@register("request_response_join")
def q_request_response_join(spark, sf):
    return V.request_response_join(R.requests_view(spark, sf),
                                   R.regression_responses_view(spark, sf))


@register("merged_response")
def q_merged_response(spark, sf):
    return V.merged_response(R.requests_view(spark, sf), R.regression_responses_view(spark, sf),
                             R.classification_responses_view(spark, sf))


@register("request_validation")
def q_request_validation(spark, sf):
    return V.request_validation(R.requests_view(spark, sf))


@register("request_defaults_form")
def q_request_defaults_form(spark, sf):
    return V.form_to_request(R.form_view(spark, sf))


@register("arrival_hour")
def q_arrival_hour(spark, sf):
    return V.form_to_request(R.form_view(spark, sf)).select(
        "request_id", "DepHour", "DepMinute", "CRSElapsedTime", "CRSArrHour")


@register("classification_response_join")
def q_classification_response_join(spark, sf):
    return V.request_response_join(R.requests_view(spark, sf),
                                   R.classification_responses_view(spark, sf), "classification")


@register("answer_bands")
def q_answer_bands(spark, sf):
    return V.answer_bands(q_merged_response(spark, sf))


@register("severity_band")
def q_severity_band(spark, sf):
    """Severity band and signed text of every regression answer."""
    m = q_merged_response(spark, sf).filter(F.col("regression_status").isNotNull())
    return V.answer_bands(m).select("request_id", "severity", "delay_text")


@register("risk_band")
def q_risk_band(spark, sf):
    """Risk bands and percent texts of every classification answer."""
    m = q_merged_response(spark, sf).filter(F.col("classification_status").isNotNull())
    return V.answer_bands(m).select("request_id", "risk_30", "risk_60", "p30_text", "p60_text")


@register("error_rows")
def q_error_rows(spark, sf):
    """Requests whose (first, in-time) answer reports an error; such an
    answer still counts as an answer in the merge."""
    m = q_merged_response(spark, sf)
    return m.filter((F.col("regression_status") == "error")
                    | (F.col("classification_status") == "error")).select(
        "request_id", "status", "regression_status", "regression_error", "classification_status")


@register("round_outputs")
def q_round_outputs(spark, sf):
    reg = R.regression_responses_view(spark, sf).withColumn(
        "predicted_delay_minutes", F.col("predicted_delay_minutes") * 1.37 - 20)
    cls = R.classification_responses_view(spark, sf).withColumns({
        "probability_over_30min": F.col("probability_over_30min") * 0.987,
        "probability_over_60min": F.col("probability_over_60min") * 1.013})
    r, c = V.round_outputs(reg, cls)
    return r.select("request_id", "predicted_delay_minutes").join(
        c.select("request_id", "probability_over_30min", "probability_over_60min"), "request_id")


@register("json_requests")
def q_json_requests(spark, sf):
    """Encode every request as JSON text, decode it with the declared
    schema and skip messages without an id (malformed bodies decode to a
    struct of nulls and are skipped the same way; see the unit tests)."""
    req = R.requests_view(spark, sf).drop("ts")
    body = F.to_json(F.struct(*req.columns)).alias("value")
    decoded = req.select(body).select(R.parse_request_json(F.col("value")).alias("r"))
    return V.valid_requests(decoded.select("r.*"))


# ---------------------------------------------------------------- models (MLlib)
from pyspark.ml.functions import vector_to_array  # noqa: E402

from .operators import metrics as MT  # noqa: E402
from .operators import ml as M  # noqa: E402

# Every registered model query has the reference sizes (the defaults of
# operators/ml.py).  Fitted models and their written tables are shared by the
# queries of one application until ``release``.
_MEMO: dict = {}


def _memo(key, make):
    """Fitted models and persisted model tables, per running application
    (a new session never sees frames of a stopped one)."""
    spark = key[1]
    key = (key[0], spark.sparkContext.applicationId) + tuple(key[2:])
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def release() -> None:
    """Forget the fitted models and delete every written table."""
    from .plans.sizing import release_tables
    _MEMO.clear()
    release_tables()


_MODEL_COLUMNS = K.CATEGORICAL_FEATURES + K.NUMERIC_FEATURES_WITH_DEP


def regression_model_table(spark, sf) -> DataFrame:
    """Model columns of all enriched trips, written once."""
    from .plans.sizing import materialize
    return _memo(("reg_table", spark, sf), lambda: materialize(C.model_input(
        enriched_regression(spark, sf, _MODEL_COLUMNS), K.NUMERIC_FEATURES_WITH_DEP, [K.TARGET])))


def _written_split(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts, written: drawing them sorts the whole table, and many
    passes go over each, each task with its share of the rows."""
    from .plans.sizing import materialize
    train, test = M.random_split(M.dealt(table))
    return materialize(train), materialize(test)


def regression_split(spark, sf):
    return _memo(("reg_split", spark, sf),
                 lambda: _written_split(regression_model_table(spark, sf)))


def regression_prepared(spark, sf, kind: str) -> M.Prepared:
    numeric = K.NUMERIC_FEATURES if kind == "A" else K.NUMERIC_FEATURES_WITH_DEP
    def make():
        train, test = regression_split(spark, sf)
        return M.prepare(train, test, numeric)
    return _memo(("reg_prep", spark, sf, kind), make)


def regression_fits(spark, sf, kind: str, *names: str) -> list:
    """The named models of a kind (all by default); each is fitted when a
    query first asks for it."""
    every = M.regressors()
    held = _memo(("reg_fits", spark, sf, kind), dict)
    missing = {n: e for n, e in every.items() if n in (names or every) and n not in held}
    if missing:
        for f in M.train_compare(regression_prepared(spark, sf, kind), missing, kind):
            f.position = list(every).index(f.name)
            held[f.name] = f
    return [held[n] for n in names or every]


def regression_fit(spark, sf, kind: str, name: str):
    return regression_fits(spark, sf, kind, name)[0]


def classification_model_table(spark, sf) -> DataFrame:
    from .plans.sizing import materialize
    labels = [f"DelayOver{t}" for t in K.LABEL_THRESHOLDS]
    return _memo(("cls_table", spark, sf), lambda: materialize(C.model_input(
        classification_table(spark, sf, _MODEL_COLUMNS), K.NUMERIC_FEATURES, labels)))


def classification_prepared(spark, sf) -> M.Prepared:
    def make():
        train, test = _written_split(classification_model_table(spark, sf))
        return M.prepare(train, test, K.NUMERIC_FEATURES,
                         labels=[f"DelayOver{t}" for t in K.LABEL_THRESHOLDS])
    return _memo(("cls_prep", spark, sf), make)


def classification_fit(spark, sf, threshold: int):
    from .plans.sizing import materialize
    label = f"DelayOver{threshold}"
    def make():
        prep = classification_prepared(spark, sf)
        model = M.classifier(label).fit(prep.train)
        # the forest goes over the test rows once, for metrics and answers
        scored = materialize(model.transform(prep.test).select(label, "probability", "prediction"))
        return M.Fitted(label, "classification", model, M.classification_scores(scored, label), 0, prep, scored)
    return _memo(("cls_fit", spark, sf, threshold), make)


@register("string_index")
def q_string_index(spark, sf):
    """Index of every category value (frequency order, ties by label): one
    grouping-sets count over the five columns, ranked over key ranges."""
    return category_index(enriched_regression(spark, sf, K.CATEGORICAL_FEATURES), K.CATEGORICAL_FEATURES)


@register("indexed_rows")
def q_indexed_rows(spark, sf):
    """The five categories of every row next to their joined indices."""
    table = regression_model_table(spark, sf).select(*K.CATEGORICAL_FEATURES)
    index = category_index(table, K.CATEGORICAL_FEATURES)
    out = with_indices(table, index, K.CATEGORICAL_FEATURES)
    return out.select(*K.CATEGORICAL_FEATURES, *[F.col(f"{c}Index").cast("int").alias(f"{c}Index")
                                                 for c in K.CATEGORICAL_FEATURES])


def _fitted_stages(spark, sf, names: int) -> DataFrame:
    """The first feature stages, fitted on the whole model table."""
    from pyspark.ml import Pipeline
    table = M.fill_inputs(regression_model_table(spark, sf), K.NUMERIC_FEATURES_WITH_DEP)
    stages = M.feature_stages(K.NUMERIC_FEATURES_WITH_DEP, scaler="standard")[:names]
    return Pipeline(stages=stages).fit(table).transform(table)


def _vector(column: str):
    """(size, indices, values) of a vector column as the JVM stores it: a
    dense vector has no size and no indices."""
    v = F.unwrap_udt(column)
    return F.coalesce(v["size"], F.size(v["values"])), v["indices"], v["values"]


@register("one_hot")
def q_one_hot(spark, sf):
    """Per row and categorical column: index, vector width, hot slot
    (1-based; 0 = all-zero vector for an unseen value), read from the sparse
    vectors."""
    enc = _fitted_stages(spark, sf, 2)
    cols = []
    for c in K.CATEGORICAL_FEATURES:
        size, indices, _ = _vector(f"{c}Vec")
        cols += [F.col(c), F.col(f"{c}Index").cast("int").alias(f"{c}Index"),
                 size.cast("int").alias(f"{c}Width"),
                 (F.coalesce(F.get(indices, F.lit(0)), F.lit(-1)) + 1).cast("int").alias(f"{c}Hot")]
    return enc.select(*cols)


@register("assemble")
def q_assemble(spark, sf):
    """Assembled vector width and number of non-zero slots per row."""
    size, _, values = _vector(M.RAW_FEATURES)
    return _fitted_stages(spark, sf, 3).select(
        size.cast("int").alias("width"), F.size(F.filter(values, lambda v: v != 0)).alias("nonzero"), K.TARGET)


@register("feature_pipeline")
def q_feature_pipeline(spark, sf):
    """The whole feature pipeline of the models (index, encode, scale the
    numeric block, assemble): per row the vector's width, its non-zero slots
    and the sum of its scaled numeric part."""
    from pyspark.ml import Pipeline
    table = M.fill_inputs(regression_model_table(spark, sf), K.NUMERIC_FEATURES_WITH_DEP)
    out = Pipeline(stages=M.feature_stages(K.NUMERIC_FEATURES_WITH_DEP)).fit(table).transform(table)
    size, _, values = _vector(M.FEATURES)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) - len(K.CATEGORICAL_FEATURES)
    return out.select("UniqueCarrier", "Origin", "Dest", K.TARGET, size.cast("int").alias("width"),
                      F.size(F.filter(values, lambda v: v != 0)).alias("nonzero"),
                      F.round(total, 6).alias("numeric_sum"))


def _scaled_columns(spark, sf, scaler: str):
    """All numeric inputs next to their scaled values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
    cols = K.NUMERIC_FEATURES_WITH_DEP
    table = M.fill_inputs(regression_model_table(spark, sf), cols).select(*cols)
    asm = VectorAssembler(inputCols=cols, outputCol="v")
    sc = (MinMaxScaler(inputCol="v", outputCol="s") if scaler == "minmax"
          else StandardScaler(inputCol="v", outputCol="s", withMean=False, withStd=True))
    out = Pipeline(stages=[asm, sc]).fit(table).transform(table)
    arr = vector_to_array(F.col("s"))
    return out.select(*cols, *[F.round(arr.getItem(i), 9).alias(f"{c}_scaled")
                               for i, c in enumerate(cols)])


@register("min_max_scale")
def q_min_max_scale(spark, sf):
    return _scaled_columns(spark, sf, "minmax")


@register("standard_scale")
def q_standard_scale(spark, sf):
    return _scaled_columns(spark, sf, "standard")


def _carrier_hour_average(df: DataFrame) -> DataFrame:
    """Only the one statistic that the baselines use."""
    out = J.enrich_single(df, "carrier_hour_stats")
    return out.withColumn("AvgCarrierHourDelay", F.coalesce("AvgCarrierHourDelay", F.lit(0.0)))


def _baseline_predictions(spark, sf) -> DataFrame:
    """The statistics baseline: predict the carrier x hour average."""
    return _carrier_hour_average(_reg(spark, sf)).select(
        K.TARGET, F.col("AvgCarrierHourDelay").alias("prediction"))


@register("regression_metrics")
def q_regression_metrics(spark, sf):
    m = MT.regression_metrics(_baseline_predictions(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")], "n")


@register("residuals")
def q_residuals(spark, sf):
    res = M.with_residuals(_baseline_predictions(spark, sf))
    return D.histogram(res, "Residual", 50)


def _cls_baseline(spark, sf) -> DataFrame:
    # the statistic counts rows whose delay is null, as the classification
    # table does; labels and the null drop come after it
    base = C.clean_classification_base(flights_view(spark, sf))
    t = _carrier_hour_average(base).withColumn("DelayOver30", X.delay_label(30)).dropna(
        subset=["ArrDelay", "UniqueCarrier", "Origin", "Dest"])
    return t.select("DelayOver30", F.col("AvgCarrierHourDelay").alias("score"),
                    F.when(F.col("AvgCarrierHourDelay") > 30, 1.0).otherwise(0.0).alias("prediction"))


@register("auc_rank_sum")
def q_auc_rank_sum(spark, sf):
    a = MT.auc_rank_sum(_cls_baseline(spark, sf), "score", "DelayOver30")
    return a.withColumn("auc", F.round("auc", 9))


@register("auc_many_scores")
def q_auc_many_scores(spark, sf):
    """The same area on a score with very many distinct values."""
    t = labelled_flights(spark, sf).filter(F.col("DepDelay").isNotNull())
    # the delay plus a fraction of other columns: nearly every trip its own
    spread = sum(F.col(c).cast("bigint") * k for c, k in (
        ("FlightNum", 7919), ("AirTime", 104729), ("ActualElapsedTime", 1299709), ("TaxiOut", 15485863)))
    score = F.col("DepDelay") + (spread % 1000003) / F.lit(100003.0)
    a = MT.auc_rank_sum(t.select(score.alias("score"), "DelayOver30"), "score", "DelayOver30")
    return a.withColumn("auc", F.round("auc", 9))


@register("accuracy")
def q_accuracy(spark, sf):
    return MT.accuracy(_cls_baseline(spark, sf), "DelayOver30").withColumn(
        "accuracy", F.round("accuracy", 9))


def _predictions(fitted: M.Fitted) -> DataFrame:
    return fitted.model.transform(fitted.prepared.test).select(K.TARGET, "prediction")


@register("regression_lr")
def q_regression_lr(spark, sf):
    return _predictions(regression_fit(spark, sf, "A", "Linear Regression"))


@register("regression_rf")
def q_regression_rf(spark, sf):
    return _predictions(regression_fit(spark, sf, "A", "Random Forest"))


@register("regression_gbt")
def q_regression_gbt(spark, sf):
    return _predictions(regression_fit(spark, sf, "A", "GBT Regressor"))


@register("linear_one_input")
def q_linear_one_input(spark, sf):
    """The linear model on one input (departure delay) over the whole model
    table: its line has a closed form."""
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=["DepDelay"], outputCol=M.FEATURES).transform(
        regression_model_table(spark, sf).select("DepDelay", K.TARGET))
    model = M.regressors()["Linear Regression"].fit(rows)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(model.intercept, 6))],
                                 "slope double, intercept double")


@register("stump_predictions")
def q_stump_predictions(spark, sf):
    """One boosting step, one tree of a forest and one tree of a risk forest
    over two flags of the whole model table, asked about every pair of flags:
    the best split and its means have a closed form."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    from .plans.sizing import materialize
    flags = ["IsWeekend", "IsRushHour"]
    rows = materialize(VectorAssembler(inputCols=flags, outputCol=M.FEATURES).transform(
        regression_model_table(spark, sf).select(*flags, K.TARGET, (F.col(K.TARGET) > 30).cast("int").alias("late"))))
    cases = rows.select(*flags, M.FEATURES).distinct()
    common = {"featuresCol": M.FEATURES, "maxDepth": 1, "seed": 42}
    one = {**common, "numTrees": 1, "bootstrap": False}
    models = {"boosted step": GBTRegressor(labelCol=K.TARGET, maxIter=1, **common),
              "forest tree": RandomForestRegressor(labelCol=K.TARGET, **one),
              "risk tree": RandomForestClassifier(labelCol="late", **one)}
    out = None
    for name, estimator in models.items():
        scored = estimator.fit(rows).transform(cases)
        value = F.col("prediction") if name != "risk tree" else M.positive_percent() / 100
        part = scored.select(F.lit(name).alias("model"), *flags, F.round(value, 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _cls_predictions(spark, sf, t):
    f = classification_fit(spark, sf, t)
    label = f"DelayOver{t}"
    return f.scored.select(label, "prediction", F.round(M.positive_percent(), 6).alias("probability_pct"))


@register("classification_30")
def q_classification_30(spark, sf):
    return _cls_predictions(spark, sf, 30)


@register("classification_60")
def q_classification_60(spark, sf):
    return _cls_predictions(spark, sf, 60)


@register("classification_sample")
def q_classification_sample(spark, sf):
    """Label, prediction and probability of a few test rows."""
    return _cls_predictions(spark, sf, 30).limit(10)


@register("classification_metrics")
def q_classification_metrics(spark, sf):
    rows = []
    for t in K.LABEL_THRESHOLDS:
        f = classification_fit(spark, sf, t)
        rows.append((f.name, float(f.metrics["auc"]), float(f.metrics["accuracy"])))
    return spark.createDataFrame(rows, "label string, auc double, accuracy double")


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    fits = regression_fits(spark, sf, "A") + regression_fits(spark, sf, "B")
    return M.leaderboard(spark, fits)


@register("best_model")
def q_best_model(spark, sf):
    return M.best_model(q_model_leaderboard(spark, sf))


def _tuning(spark, sf) -> dict:
    return _memo(("tune", spark, sf),
                 lambda: M.tune_gbt(regression_split(spark, sf)[0], regression_prepared(spark, sf, "A")))


@register("tune_gbt")
def q_tune_gbt(spark, sf):
    return M.tuning_frame(spark, _tuning(spark, sf))


@register("tuning_gain")
def q_tuning_gain(spark, sf):
    """Baseline vs tuned RMSE: absolute and relative improvement."""
    return M.tuning_frame(spark, _tuning(spark, sf)).select(
        "rmse_baseline", "rmse_tuned", "gain", "gain_pct")


@register("tuning_board")
def q_tuning_board(spark, sf):
    """Cross-validated error of every grid point."""
    return spark.createDataFrame(_tuning(spark, sf)["board"], "maxIter int, maxDepth int, rmse double")


@register("fold_sizes")
def q_fold_sizes(spark, sf):
    """Rows and label sum of each cross-validation fold of the model table."""
    rows = M.with_folds(M.fill_inputs(regression_model_table(spark, sf), K.NUMERIC_FEATURES))
    return rows.groupBy(F.col(M.FOLD).alias("fold")).agg(F.count(F.lit(1)).alias("n"),
                                                        F.round(F.sum(K.TARGET), 6).alias("label_sum"))


@register("fold_stages")
def q_fold_stages(spark, sf):
    """What the fitted feature stages of each fold hold: number of known
    values and most frequent one of every category, ends of every numeric
    input, all without the fold's own rows."""
    numeric = K.NUMERIC_FEATURES
    rows = M.with_folds(M.fill_inputs(regression_model_table(spark, sf), numeric))
    statistics = M.fold_statistics(rows, numeric)
    out = []
    for k in range(3):
        *index, _, _, scaler, _ = M.fold_stages(rows, statistics, k, numeric).stages
        out += [(k, c, len(m.labels), m.labels[0], None, None) for c, m in zip(K.CATEGORICAL_FEATURES, index)]
        out += [(k, c, None, None, float(lo), float(hi))
                for c, lo, hi in zip(numeric, scaler.originalMin, scaler.originalMax)]
    return spark.createDataFrame(out, "fold int, input string, labels int, top string, low double, high double")


@register("feature_importance")
def q_feature_importance(spark, sf):
    f = regression_fit(spark, sf, "A", "Random Forest")
    names = M.feature_names(f.prepared.train, f.prepared.numeric)
    return M.feature_importance(spark, f.model, names, top=20)


@register("residuals_sample")
def q_residuals_sample(spark, sf):
    best = M.pick_best(regression_fits(spark, sf, "A"))
    return M.with_residuals(_predictions(best)).sample(False, 0.05, 42)


def regression_models(spark, sf):
    """Pipelines as they are saved for serving: A = boosted trees without
    departure delay, B = linear regression with it."""
    return (regression_fit(spark, sf, "A", "GBT Regressor").pipeline(),
            regression_fit(spark, sf, "B", "Linear Regression").pipeline())


def classification_models(spark, sf):
    """The served forests for 30 and 60 minutes."""
    return classification_fit(spark, sf, 30).pipeline(), classification_fit(spark, sf, 60).pipeline()


@register("score_regression")
def q_score_regression(spark, sf):
    a, b = regression_models(spark, sf)
    feats = V.request_features(R.requests_view(spark, sf), serving_stats(spark, sf))
    return M.score_regression(feats, a, b)


@register("score_classification")
def q_score_classification(spark, sf):
    c30, c60 = classification_models(spark, sf)
    feats = V.request_features(R.requests_view(spark, sf), serving_stats(spark, sf))
    return M.score_classification(feats, c30, c60)


# ---------------------------------------------------------------- sampling / splitting
@register("sample_bernoulli")
def q_sample_bernoulli(spark, sf):
    from .operators.sampling import bernoulli_sample
    return bernoulli_sample(_eda(spark, sf).select("ArrDelay"), 0.1)


@register("sample_capped")
def q_sample_capped(spark, sf, cap: int = 5000):
    from .operators.sampling import capped_sample
    return capped_sample(_eda(spark, sf).select("Distance", "ArrDelay"), cap)


@register("sample_keyed")
def q_sample_keyed(spark, sf):
    """A tenth of the rows by key: the same in every run and on every engine."""
    from .operators.sampling import keyed_sample
    return keyed_sample(_eda(spark, sf).select("Distance", "ArrDelay"), 0.1)


@register("random_split")
def q_random_split(spark, sf):
    train, test = M.random_split(_reg(spark, sf).select("UniqueCarrier", "ArrDelay"))
    return (train.withColumn("split", F.lit("train"))
                 .unionByName(test.withColumn("split", F.lit("test"))))


@register("stable_split")
def q_stable_split(spark, sf):
    from .operators.sampling import stable_split_label
    df = _reg(spark, sf)
    return df.select("FlightNum", "TaxiOut", "AirTime", "ArrDelay",
                     stable_split_label(["FlightNum", "TaxiOut", "AirTime"]).alias("split"))


@register("model_input")
def q_model_input(spark, sf):
    """Model columns in a fixed order (categoricals, numerics, label)."""
    return C.model_input(enriched_regression(spark, sf, _MODEL_COLUMNS), K.NUMERIC_FEATURES_WITH_DEP, [K.TARGET])


@register("null_inputs")
def q_null_inputs(spark, sf):
    """Null numeric model inputs per column: what the fill policy replaces."""
    return M.null_inputs(regression_model_table(spark, sf), K.NUMERIC_FEATURES_WITH_DEP)


@register("request_ids")
def q_request_ids(spark, sf):
    """Form submissions tagged with fresh ids, written once so the ids stay
    fixed, then sent on as requests."""
    from .plans.sizing import materialize
    tagged = materialize(V.tag_requests(R.form_view(spark, sf).drop("request_id")))
    return tagged.select("request_id", "dep_time", "duration_text")


@register("first_rows")
def q_first_rows(spark, sf):
    return flights_view(spark, sf).limit(5)


# ---------------------------------------------------------------- streaming (replayed)
from .streaming import io as SIO  # noqa: E402
from .streaming import merge as SM  # noqa: E402
from .streaming import replay as RP  # noqa: E402
from .streaming import scoring as SS  # noqa: E402
from .streaming import sinks as SK  # noqa: E402


def _response_tables(spark, sf):
    return {"requests": R.requests_view(spark, sf),
            "regression": R.regression_responses_view(spark, sf),
            "classification": R.classification_responses_view(spark, sf)}


@register("stream_merge_responses")
def q_stream_merge_responses(spark, sf):
    return RP.replay(spark, _response_tables(spark, sf),
                     lambda s: SM.merge_response_streams(s["requests"], s["regression"],
                                                         s["classification"]),
                     event_time=True)


@register("stream_single_response")
def q_stream_single_response(spark, sf):
    t = _response_tables(spark, sf)
    del t["classification"]
    return RP.replay(spark, t, lambda s: SM.single_response_stream(s["requests"], s["regression"]),
                     event_time=True)


@register("stream_single_classification")
def q_stream_single_classification(spark, sf):
    t = _response_tables(spark, sf)
    del t["regression"]
    return RP.replay(spark, t, lambda s: SM.single_response_stream(
        s["requests"], s["classification"], "classification"), event_time=True)


@register("stream_answer_lag")
def q_stream_answer_lag(spark, sf):
    """Seconds from each request to the sending of its merged answer, on the
    stamps of the messages: a complete answer leaves with its last part, any
    other at the deadline."""
    merged = RP.replay(spark, _response_tables(spark, sf),
                       lambda s: SM.merge_response_streams(s["requests"], s["regression"], s["classification"],
                                                           lag=True), event_time=True)
    return merged.select("request_id", "status", F.round("sent_after", 6).alias("sent_after"))


@register("stream_score_regression")
def q_stream_score_regression(spark, sf):
    a, b = regression_models(spark, sf)
    stats = serving_stats(spark, sf)
    return RP.replay(spark, {"requests": R.requests_view(spark, sf)},
                     lambda s: SS.score_regression_stream(s["requests"], stats, a, b))


@register("stream_score_classification")
def q_stream_score_classification(spark, sf):
    c30, c60 = classification_models(spark, sf)
    stats = serving_stats(spark, sf)
    return RP.replay(spark, {"requests": R.requests_view(spark, sf)},
                     lambda s: SS.score_classification_stream(s["requests"], stats, c30, c60))


@register("stream_fan_out")
def q_stream_fan_out(spark, sf):
    """Each valid request is sent to both input topics (one source, one
    micro-batch, two sinks)."""
    root = RP.scratch(spark)
    req = R.requests_view(spark, sf)
    req.write.json(f"{root}/in")
    stream = V.valid_requests(spark.readStream.schema(req.schema).json(f"{root}/in"))
    topics = ["input-regression", "input-classification"]

    def writer(topic):
        put = SK.file_topic_writer(f"{root}/out/topic={topic}", "fan-out", "parquet")
        return lambda batch, batch_id: put(SIO.to_messages(batch), batch_id)

    q = (SS.fan_out(stream, {t: writer(t) for t in topics})
           .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")
