"""Readers and stores: CSV with a declared schema, JSON request bodies,
statistics save/load (missing tables read as empty)."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import table
from tardy.catalog import REGISTRY, _reg
from tardy.operators import clean as C
from tardy.operators import stats as S
from tardy.sources.flights import flights_view, read_flights_csv
from tardy.sources.requests import read_request_batch, requests_view


def _tmp():
    return tempfile.mkdtemp(prefix="tardy-test-")


def test_csv_round_trip_and_clean(spark):
    path = os.path.join(_tmp(), "flights")
    flights_view(spark, SF_SMALL).write.option("header", True).csv(path)
    raw = read_flights_csv(spark, path)
    assert raw.schema["DepDelay"].dataType.simpleString() == "string"
    a = C.clean_regression(raw).drop("Date")
    b = C.clean_regression(flights_view(spark, SF_SMALL)).drop("Date")
    assert table(a.toPandas()) == table(b.toPandas())


def test_bad_delay_text_becomes_null_and_is_dropped(spark):
    path = os.path.join(_tmp(), "bad.csv")
    with open(path, "w") as f:
        f.write("Date,DayOfWeek,DepTime,ArrTime,CRSArrTime,UniqueCarrier,FlightNum,Origin,Dest,Distance,"
                "CRSElapsedTime,ActualElapsedTime,AirTime,TaxiIn,TaxiOut,DepDelay,ArrDelay,Cancelled,Diverted,"
                "CancellationCode,CarrierDelay,WeatherDelay,NASDelay,SecurityDelay,LateAircraftDelay\n")
        f.write("03-01-2019,4,1420,1600,1550,AA,1,ORD,LAX,1745,240,230,200,5,15,NA,12,0,0,,0,0,0,0,0\n")
        f.write("03-01-2019,4,1420,1600,1550,AA,1,ORD,LAX,1745,240,230,200,5,15,3,12,0,0,,0,0,0,0,0\n")
    out = C.clean_regression(read_flights_csv(spark, path)).collect()
    assert len(out) == 1 and out[0].DepDelay == 3.0 and out[0].DepHour == 14


def test_json_request_batch(spark):
    path = os.path.join(_tmp(), "req")
    requests_view(spark, SF_SMALL).drop("ts").write.json(path)
    back = read_request_batch(spark, path)
    assert back.count() == requests_view(spark, SF_SMALL).count()


def test_stats_save_load(spark):
    path = os.path.join(_tmp(), "stats")
    stats = S.compute_stats(_reg(spark, SF_SMALL))
    stats["route_distances"] = S.route_distances(flights_view(spark, SF_SMALL))
    del stats["dest_stats"]
    S.save_stats(stats, path)
    loaded = S.load_stats(spark, path)
    assert set(loaded) == set(S.STATS_SCHEMAS)
    assert loaded["dest_stats"].count() == 0
    assert loaded["carrier_stats"].count() == stats["carrier_stats"].count()


def test_request_ids_are_unique_and_stable(spark):
    df = REGISTRY["request_ids"](spark, SF_SMALL)
    first = sorted(r.request_id for r in df.collect())
    assert len(first) == len(set(first)) == df.count()
    assert first == sorted(r.request_id for r in df.collect())
    assert df.filter(F.length("request_id") != 36).count() == 0


class _Reader:
    """Stands for a topic reader: records what reaches it."""

    def __init__(self, rows):
        self.rows, self.kind, self.seen = rows, None, {}

    def format(self, kind):
        self.kind = kind
        return self

    def options(self, **options):
        self.seen |= options
        return self

    def load(self, *_):
        return self.rows


class _Session:
    def __init__(self, reader):
        self.readStream = reader


def test_topic_options_and_start_position_reach_the_reader(spark):
    import datetime as dt

    from tardy.sources.schemas import REQUEST_SCHEMA
    from tardy.streaming.io import read_json_stream

    when = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(b'{"request_id": "a", "DepHour": 7}', when), (b"not json", when), (None, when)],
                                 "value binary, timestamp timestamp")
    for given, start in (({}, "latest"), ({"startingOffsets": "earliest"}, "earliest")):
        reader = _Reader(rows)
        options = {"kafka.bootstrap.servers": "b:9092", "subscribe": "t", **given}
        got = read_json_stream(_Session(reader), REQUEST_SCHEMA, options=options)
        assert reader.kind == "kafka" and reader.seen == {**options, "startingOffsets": start}
        assert options == {"kafka.bootstrap.servers": "b:9092", "subscribe": "t", **given}
        assert got.columns == [*REQUEST_SCHEMA.fieldNames(), "ts"]
        assert [(r.request_id, r.DepHour, r.ts) for r in got.collect()] == [
            ("a", 7, when), (None, None, when), (None, None, when)]
