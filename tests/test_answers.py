"""Answers leave when they are complete; sinks survive a second run."""

import datetime as dt
import json
import random
import tempfile

import pytest

from pyspark.sql import functions as F

from tardy.sources.schemas import ANSWER_SCHEMAS
from tardy.streaming import merge as SM
from tardy.streaming import scoring as SS
from tardy.streaming import sinks as SK

KINDS = ["regression", "classification"]
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
REQ = "request_id string, ts timestamp"
ANSWERS = {"regression": "request_id string, predicted_delay_minutes double, model_type string, status string, "
                         "error string, ts timestamp",
           "classification": "request_id string, probability_over_30min double, probability_over_60min double, "
                             "status string, error string, ts timestamp"}


def us(seconds):
    return int(seconds * 1_000_000)


def body(kind, x=1.0, status="success"):
    values = {"status": status}
    values["predicted_delay_minutes" if kind == KINDS[0] else "probability_over_30min"] = x
    return json.dumps(values)


def test_a_request_leaves_with_its_last_answer():
    s = SM.Open(KINDS, 10)
    s.add("request", us(100), None, None)
    s.add("regression", us(100.5), body("regression"), None)
    assert s.take(0) == []
    s.add("classification", us(101), body("classification"), None)
    (t, at, complete, answers), = s.take(0)
    assert (t, at, complete, set(answers)) == (us(100), us(101), True, set(KINDS))
    # repeats of the request or its answers send nothing
    s.add("request", us(100), None, None)
    s.add("regression", us(100.7), body("regression", 9.0), None)
    assert s.take(0) == []


def test_deadline_and_early_answers():
    s = SM.Open(KINDS, 10)
    s.add("regression", us(99), body("regression"), None)      # before the request: not counted
    s.add("classification", us(103), body("classification"), None)  # read before the request
    s.add("request", us(100), None, None)
    s.add("regression", us(110.000001), body("regression"), None)   # after the deadline
    assert s.take(110_000) == []
    (t, at, complete, answers), = s.take(110_001)
    assert (t, at, complete, list(answers)) == (us(100), us(110), False, ["classification"])
    assert s.take(200_000) == [] and s.next_timer() is None  # nothing is kept for ever


def test_state_survives_its_text_form():
    r = random.Random(2)
    s = SM.Open(KINDS, 10)
    for _ in range(50):
        kind = r.choice(["request", *KINDS])
        s.add(kind, us(r.randint(0, 30)), None if kind == "request" else body(kind, r.random()), None)
        s = SM.Open.load(s.dump(), KINDS, 10)
        s.take(us(r.randint(0, 20)) // 1000)
    assert SM.Open.load(s.dump(), KINDS, 10) == s


def test_the_earliest_answer_wins_ties_by_value():
    s = SM.Open(["regression"], 10)
    s.add("request", 0, None, None)
    for x, st in ((5.0, "success"), (3.0, "success"), (9.0, "error")):
        s.add("regression", us(1), body("regression", x, st), None)
    assert json.loads(s.take(0)[0][3]["regression"]) == json.loads(body("regression", 9.0, "error"))


def test_a_group_of_ids_sends_what_each_alone_would():
    r = random.Random(4)
    ids = [f"r{i}" for i in range(30)]
    alone = {i: SM.Open(KINDS, 10) for i in ids}
    packed, clock = None, 0
    for _ in range(12):
        group = SM.Group(KINDS, 10, packed)
        for _ in range(40):
            rid, kind, at = r.choice(ids), r.choice(["request", *KINDS]), us(clock + r.randint(0, 12))
            text = None if kind == "request" else body(kind, r.random())
            group.of(rid).add(kind, at, text, None)
            alone[rid].add(kind, at, text, None)
        clock += r.randint(0, 9)
        want = [(i, t, at, a) for i, o in alone.items() for t, at, _, a in o.take(clock * 1000)]
        assert sorted(group.take(clock * 1000), key=repr) == sorted(want, key=repr)
        timers = [o.next_timer() for o in alone.values()]
        assert group.next_timer() == min((t for t in timers if t is not None), default=None)
        packed = group.pack()


def test_the_merge_keeps_no_state_for_every_single_id(spark):
    root = tempfile.mkdtemp(prefix="tardy-answers-")
    n = 3 * SM.BUCKETS
    _feed(spark, root, "requests", [(f"r{i}", T0) for i in range(n)], REQ)
    for kind in KINDS:
        _feed(spark, root, kind, [_answer(kind, "zz", 0.5)], ANSWERS[kind])
    schemas = {"requests": REQ, **ANSWERS}
    streams = {k: spark.readStream.schema(s).json(f"{root}/{k}") for k, s in schemas.items()}
    q = (SM.merge_response_streams(streams["requests"], *[streams[k] for k in KINDS]).writeStream.format("noop")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= SM.BUCKETS


def _feed(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{root}/{name}")


def _start(spark, root, event_time):
    schemas = {"requests": REQ, **ANSWERS}
    streams = {n: spark.readStream.schema(s).json(f"{root}/{n}") for n, s in schemas.items()}
    plan = SM.merge_response_streams(streams["requests"], *[streams[k] for k in KINDS], event_time=event_time)

    def run():
        q = (plan.writeStream.format("json").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        return {r.request_id: r.status for r in spark.read.json(f"{root}/out").collect()} \
            if spark.read.text(f"{root}/out").count() else {}
    return run


def _answer(kind, rid, seconds, x=1.0):
    when = T0 + dt.timedelta(seconds=seconds)
    if kind == "regression":
        return (rid, x, "A", "success", None, when)
    return (rid, x, x, "success", None, when)


def test_complete_answers_do_not_wait_for_the_watermark(spark):
    root = tempfile.mkdtemp(prefix="tardy-answers-")
    schema = ANSWERS
    at = lambda s: T0 + dt.timedelta(seconds=s)
    _feed(spark, root, "requests", [("a", at(0)), ("b", at(0)), (None, at(0))], REQ)
    _feed(spark, root, "regression", [_answer("regression", "a", 0.5), _answer("regression", "b", 0.5)],
          schema["regression"])
    _feed(spark, root, "classification", [_answer("classification", "zz", 0.5)], schema["classification"])
    run = _start(spark, root, True)
    assert run() == {}
    # the second answer of "a", one second after its request
    _feed(spark, root, "classification", [_answer("classification", "a", 1)], schema["classification"])
    assert run() == {"a": "success"}
    # messages of other requests carry the clock past the deadline of "b"
    for s in (12, 40):
        _feed(spark, root, "requests", [(f"later{s}", at(s))], REQ)
        got = run()
    assert got == {"a": "success", "b": "partial", "later12": "timeout"}


def test_timeouts_on_the_wall_clock_need_no_messages(spark):
    root = tempfile.mkdtemp(prefix="tardy-answers-")
    _feed(spark, root, "requests", [("a", dt.datetime.now())], REQ)
    for kind in KINDS:
        spark.createDataFrame([], ANSWER_SCHEMAS[kind]).coalesce(1).write.json(f"{root}/{kind}")
    streams = {"requests": spark.readStream.schema(REQ).json(f"{root}/requests"),
               **{k: spark.readStream.schema(ANSWER_SCHEMAS[k]).json(f"{root}/{k}")
                  .withColumn("ts", F.current_timestamp()) for k in KINDS}}
    q = (SM.merge_response_streams(streams["requests"], *[streams[k] for k in KINDS], deadline=2, event_time=False)
         .writeStream.format("json").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .trigger(processingTime="500 milliseconds").start())
    try:
        import time
        for _ in range(60):
            time.sleep(0.5)
            rows = spark.read.schema("request_id string, status string").json(f"{root}/out").collect() \
                if q.lastProgress else []
            if rows:
                break
    finally:
        q.stop()
    assert [(r.request_id, r.status) for r in rows] == [("a", "timeout")]


# --- sinks -------------------------------------------------------------------

class Stopped(Exception):
    pass


def _messages(spark, n=200):
    return spark.range(n, numPartitions=4).select(F.col("id").cast("string").alias("key"),
                                                  F.concat(F.lit("v"), "id").alias("value"))


def test_a_batch_that_runs_twice_is_sent_once(spark):
    root = tempfile.mkdtemp(prefix="tardy-sink-")
    put = SK.file_topic_writer(f"{root}/t", "one")
    df = _messages(spark)
    put(df, 0)
    put(df.repartition(7), 0)
    put(df, 1)
    other = SK.file_topic_writer(f"{root}/t", "two")
    other(df, 0)
    got = spark.read.json(f"{root}/t").groupBy("key").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {3}


@pytest.mark.parametrize("moves", range(6))
def test_a_writer_stopped_at_any_rename_ends_whole(spark, moves, monkeypatch):
    """The writer stops after ``moves`` renames and runs again with the rows
    dealt to other files."""
    root = tempfile.mkdtemp(prefix="tardy-sink-")
    put, df, real = SK.file_topic_writer(f"{root}/t", "one"), _messages(spark), SK._Records.move
    left = [moves]

    def move(self, a, b):
        if not left[0]:
            raise Stopped
        left[0] -= 1
        real(self, a, b)

    monkeypatch.setattr(SK._Records, "move", move)
    with pytest.raises(Stopped):
        put(df, 0)
    monkeypatch.setattr(SK._Records, "move", real)
    put(df.repartition(3), 0)
    got = spark.read.json(f"{root}/t")
    assert got.count() == 200 and got.select("key").distinct().count() == 200


def test_fan_out_killed_between_its_sinks(spark):
    root = tempfile.mkdtemp(prefix="tardy-sink-")
    _messages(spark).write.json(f"{root}/in")
    fail = [True]
    first, second = (SK.file_topic_writer(f"{root}/{t}", t) for t in "ab")

    def breaking(batch, batch_id):
        if fail[0]:
            raise Stopped
        second(batch, batch_id)

    def run():
        stream = spark.readStream.schema("key string, value string").json(f"{root}/in")
        q = (SS.fan_out(stream, {"a": first, "b": breaking}).option("checkpointLocation", f"{root}/ckpt")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    with pytest.raises(Exception):
        run()
    assert spark.read.json(f"{root}/a").count() == 200
    fail[0] = False
    run()
    for t in "ab":
        got = spark.read.json(f"{root}/{t}")
        assert got.count() == 200 and got.select("key").distinct().count() == 200
