"""Train -> save -> load -> the whole online path over file topics."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy import app
from tardy.operators import ml as M
from tardy.operators import serving as V
from tardy.sources.flights import flights_view
from tardy.sources.requests import requests_view

SMALL = {"gbt_iter": 5, "gbt_depth": 3, "rf_trees": 5, "rf_depth": 5}


def test_the_reference_sizes_are_the_defaults(spark):
    models = M.regressors()
    gbt, forest = models["GBT Regressor"], models["Random Forest"]
    assert (gbt.getMaxIter(), gbt.getMaxDepth()) == (100, 7)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (20, 10)
    assert (M.classifier("x").getNumTrees(), M.classifier("x").getMaxDepth()) == (50, 10)


def test_train_save_load_and_the_online_path(spark):
    root = tempfile.mkdtemp(prefix="tardy-app-")
    res = app.train(spark, flights_view(spark, SF_SMALL), f"{root}/state", SMALL, {"trees": 5, "depth": 5})
    assert res.leaderboard.count() == 6 and res.classification.count() == 2
    assert set(res.best) == {"A", "B"}
    for d in app.MODEL_DIRS.values():
        assert os.path.isdir(f"{root}/state/{d}")
    serving = app.load_serving(spark, f"{root}/state")
    assert serving.model_a is not None and serving.model_60 is not None

    req = requests_view(spark, SF_SMALL).drop("ts").limit(400)
    req.write.json(f"{root}/requests")
    once = {"trigger": {"availableNow": True}}
    kinds = ("regression", "classification")

    def topic(name):
        return {"path": f"{root}/{name}", "messages": "true"}

    app.dispatch(spark, "json", f"{root}/ckpt/dispatch", {"path": f"{root}/requests"},
                 {k: {"path": f"{root}/in-{k}"} for k in kinds}, **once).awaitTermination()
    for q in app.serve(spark, serving, "json", f"{root}/ckpt", inputs={k: topic(f"in-{k}") for k in kinds},
                       outputs={k: {"path": f"{root}/out-{k}"} for k in kinds}, **once):
        q.awaitTermination()
    valid = V.valid_requests(spark.read.schema(req.schema).json(f"{root}/requests")).count()
    for kind in kinds:
        out = spark.read.json(f"{root}/out-{kind}")
        assert out.count() == valid
        assert out.filter(F.get_json_object("value", "$.status") != "success").count() == 0
        # a topic that others may append to (a stream's folder lists only its own files)
        out.write.json(f"{root}/answers-{kind}")

    def collect(name, answers):
        q = app.collect_answers(spark, "json", f"{root}/ckpt/{name}", topic("in-regression"),
                                {k: topic(f"answers-{k}") for k in answers}, {"path": f"{root}/{name}"},
                                deadline=600, event_time=True, **once)
        q.awaitTermination()

    jobs = {"merged": kinds, "only-regression": kinds[:1], "only-classification": kinds[1:]}
    for name, answers in jobs.items():
        collect(name, answers)
    # later messages move the watermark past every deadline, which sends the rows
    for day in (1, 2):
        late = dt.datetime.now() + dt.timedelta(days=day)
        for name in ("in-regression", "answers-regression", "answers-classification"):
            spark.createDataFrame([("late", json.dumps({"request_id": f"late{day}"}), late)],
                                  "key string, value string, timestamp timestamp").write.mode("append").json(f"{root}/{name}")
        for name, answers in jobs.items():
            collect(name, answers)
    for name in jobs:
        rows = [json.loads(r.value) for r in spark.read.json(f"{root}/{name}").filter("not key like 'late%'").collect()]
        assert len(rows) == valid and {r["status"] for r in rows} == {"success"}
        fields = set().union(*rows)
        assert ("predicted_delay_minutes" in fields) == (name != "only-classification")
        assert ("probability_over_60min" in fields) == (name != "only-regression")

    route = serving.stats["route_distances"].filter("Distance <> 0").first()
    pairs = spark.createDataFrame([(route.Origin, route.Dest), ("X", "Y")], "Origin string, Dest string")
    got = {r.Origin: (r.found, r.distance) for r in app.lookup_distances(serving, pairs).collect()}
    assert got == {route.Origin: (True, route.Distance), "X": (False, 1000)}
