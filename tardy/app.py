"""End-to-end jobs: train and save, then serve from the saved state.

``train`` runs the whole training flow over a trip table: the six
statistics and the route distance map are saved as parquet, the two
regression feature sets (without / with departure delay) are compared
across the three regressors, the best of each is saved as a servable
pipeline, and the two risk classifiers are trained and saved.

``serve`` starts the two scoring streams (request topic -> answers topic)
from the saved state.  ``dispatch`` copies every valid incoming request to
the input topics, ``collect_answers`` reads requests and answer topics and
sends the merged answer of each request (or that of one kind) as soon as it
is complete, at the latest at its deadline, and ``lookup_distances`` answers distance queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions import constants as K
from .functions import features as X
from .operators import clean as C
from .operators import enrich as J
from .operators import ml as M
from .operators import stats as S
from .operators import serving as V
from .plans.session import configure
from .plans.sizing import MAX_BROADCAST_BYTES, materialize
from .sources.schemas import ANSWER_SCHEMAS, REQUEST_SCHEMA
from .streaming import io as SIO
from .streaming import merge as SM
from .streaming import scoring as SS
from .streaming import sinks as SK

MODEL_DIRS = {"A": "model_a", "B": "model_b", 30: "model_classification_30",
              60: "model_classification_60"}
STATS_DIR = "stats"


@dataclass
class TrainResult:
    leaderboard: DataFrame
    classification: DataFrame
    best: dict


def train(spark: SparkSession, trips: DataFrame, out_dir: str,
          regressor_sizes: dict | None = None, classifier_sizes: dict | None = None) -> TrainResult:
    """The sizes override the reference's numbers of trees, depths and
    iterations (``M.regressors``, ``M.classifier``)."""
    configure(spark)
    out = out_dir.rstrip("/")
    reg = C.clean_regression(trips)
    stats = S.compute_stats(reg)
    S.save_stats({**stats, "route_distances": S.route_distances(trips)}, f"{out}/{STATS_DIR}")
    # written once: the split and every pass over it read the same rows
    table = materialize(C.model_input(J.enrich_all(reg, stats), K.NUMERIC_FEATURES_WITH_DEP, [K.TARGET]))
    train_df, test_df = M.random_split(table)
    fits, best = [], {}
    for kind, numeric in (("A", K.NUMERIC_FEATURES), ("B", K.NUMERIC_FEATURES_WITH_DEP)):
        prep = M.prepare(train_df, test_df, numeric)
        kind_fits = M.train_compare(prep, M.regressors(**(regressor_sizes or {})), kind)
        winner = M.pick_best(kind_fits)
        M.save_model(winner.pipeline(), f"{out}/{MODEL_DIRS[kind]}")
        best[kind] = winner.name
        fits += kind_fits
        prep.release()
    # classification: statistics over status-filtered rows, late null drop
    base = C.clean_classification_base(trips)
    labels = [f"DelayOver{t}" for t in K.LABEL_THRESHOLDS]
    labelled = J.enrich_all(base).withColumns(
        {f"DelayOver{t}": X.delay_label(t) for t in K.LABEL_THRESHOLDS}
    ).dropna(subset=["ArrDelay", "UniqueCarrier", "Origin", "Dest"])
    ctrain, ctest = M.random_split(materialize(C.model_input(labelled, K.NUMERIC_FEATURES, labels)))
    cprep = M.prepare(ctrain, ctest, K.NUMERIC_FEATURES, labels=labels)
    rows = []
    for t, label in zip(K.LABEL_THRESHOLDS, labels):
        model = M.classifier(label, **(classifier_sizes or {})).fit(cprep.train)
        scores = M.classification_scores(model.transform(cprep.test), label)
        M.save_model(M.Fitted(label, "classification", model, scores, 0, cprep).pipeline(),
                     f"{out}/{MODEL_DIRS[t]}")
        rows.append((label, float(scores["auc"]), float(scores["accuracy"])))
    cprep.release()
    cls = spark.createDataFrame(rows, "label string, auc double, accuracy double")
    return TrainResult(M.leaderboard(spark, fits), cls, best)


@dataclass
class Serving:
    stats: dict
    model_a: object
    model_b: object
    model_30: object
    model_60: object


def load_serving(spark: SparkSession, out_dir: str) -> Serving:
    """Saved statistics (size-checked broadcast) and the four pipelines;
    a missing model loads as None and its stream answers with error rows."""
    out = out_dir.rstrip("/")
    stats = S.load_stats(spark, f"{out}/{STATS_DIR}", max_broadcast_bytes=MAX_BROADCAST_BYTES)
    models = {k: M.load_model(f"{out}/{d}") for k, d in MODEL_DIRS.items()}
    return Serving(stats, models["A"], models["B"], models[30], models[60])


def serve(spark: SparkSession, serving: Serving, fmt: str, checkpoint_root: str,
          inputs: dict, outputs: dict, trigger: dict | None = None):
    """Start the regression and classification scoring streams.

    ``inputs`` / ``outputs`` map ``"regression"`` / ``"classification"`` to
    source / sink options (for topics: ``{"subscribe": ...}`` and
    ``{"topic": ...}``; for files: ``{"path": ...}``).
    """
    configure(spark)
    root = checkpoint_root.rstrip("/")
    queries = []
    for kind in ("regression", "classification"):
        requests = _source(spark, REQUEST_SCHEMA, fmt, inputs[kind])
        if kind == "regression":
            answers = SS.score_regression_stream(requests, serving.stats, serving.model_a, serving.model_b)
        else:
            answers = SS.score_classification_stream(requests, serving.stats, serving.model_30,
                                                     serving.model_60)
        queries.append(_sink(answers, fmt, f"{root}/{kind}", outputs[kind], trigger))
    return queries


def _source(spark: SparkSession, schema, fmt: str, options: dict) -> DataFrame:
    src = dict(options)
    path = src.pop("path", None)
    return SIO.read_json_stream(spark, schema, src.pop("format", fmt), path=path, options=src)


def _sink(df: DataFrame, fmt: str, checkpoint: str, options: dict, trigger: dict | None):
    out = dict(options)
    path, kind = out.pop("path", None), out.pop("format", fmt)
    return SIO.write_stream(SIO.to_messages(df, stamp=kind != "kafka"), kind, checkpoint, path=path,
                            options=out, trigger=trigger)


def dispatch(spark: SparkSession, fmt: str, checkpoint: str, source: dict, outputs: dict,
             trigger: dict | None = None):
    """Every valid request to each of ``outputs`` (name -> sink options), one
    read of the source.  A batch that runs again, because the job stopped
    between two sinks or inside one, leaves each message once in a file topic
    (at least once in a broker topic)."""
    configure(spark)
    requests = V.valid_requests(_source(spark, REQUEST_SCHEMA, fmt, source))

    def writer(name: str, options: dict):
        out = dict(options)
        path, kind = out.pop("path", None), out.pop("format", fmt)
        put = (SK.broker_writer(f"{checkpoint.rstrip('/')}/sent", name, out, kind) if kind == "kafka"
               else SK.file_topic_writer(path, name, kind, out))
        return lambda batch, batch_id: put(SIO.to_messages(batch, stamp=kind != "kafka"), batch_id)

    w = SS.fan_out(requests, {k: writer(k, o) for k, o in outputs.items()}).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def collect_answers(spark: SparkSession, fmt: str, checkpoint: str, requests: dict, answers: dict,
                    output: dict, trigger: dict | None = None, delay: str = "0 seconds",
                    deadline: int = K.RESPONSE_DEADLINE_SECONDS, event_time: bool = False):
    """Merged answers of the kinds in ``answers`` (kind -> source options of
    its answer topic): both kinds give success, partial or timeout, one kind
    success or timeout.  A complete answer is sent by the batch that reads
    its last part; deadlines run on the wall clock, or with ``event_time`` on
    the stamps of the messages (then they wait for later messages)."""
    configure(spark)
    req = _source(spark, REQUEST_SCHEMA, fmt, requests)
    streams = {k: _source(spark, ANSWER_SCHEMAS[k], fmt, o) for k, o in answers.items()}
    if len(streams) == 1:
        kind, = streams
        merged = SM.single_response_stream(req, streams[kind], kind, deadline, delay, event_time)
    else:
        merged = SM.merge_response_streams(req, streams["regression"], streams["classification"], deadline, delay,
                                           event_time)
    return _sink(merged, fmt, checkpoint, output, trigger)


def lookup_distances(serving: Serving, pairs: DataFrame) -> DataFrame:
    """Distances of (Origin, Dest) rows from the saved route table."""
    return V.distance_lookup(pairs, serving.stats["route_distances"])
