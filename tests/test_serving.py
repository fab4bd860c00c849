"""Edge tables for the serving rules (defaults, lookups, joins, merge)."""

import datetime as dt

from pyspark.sql import functions as F

from tardy.operators import serving as V
from tardy.sources.requests import parse_request_json
from tardy.sources.schemas import REQUEST_SCHEMA


def _stats(spark):
    return {
        "carrier_stats": spark.createDataFrame([("AA", 10.0, 5)], "UniqueCarrier string, AvgCarrierDelay double, CarrierFlightCount bigint"),
        "hour_stats": spark.createDataFrame([(14, 20.0)], "DepHour int, AvgHourDelay double"),
        "route_stats": spark.createDataFrame([("ORD-LAX", 30.0, 7)], "Route string, AvgRouteDelay double, RouteFlightCount bigint"),
        "origin_stats": spark.createDataFrame([("ORD", 40.0)], "Origin string, AvgOriginDelay double"),
        "dest_stats": spark.createDataFrame([("LAX", 50.0)], "Dest string, AvgDestDelay double"),
        "carrier_hour_stats": spark.createDataFrame([("AA", 14, 70.0)], "UniqueCarrier string, DepHour int, AvgCarrierHourDelay double"),
    }


def _requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def test_missing_fields_take_defaults_and_lookup_misses(spark):
    req = _requests(spark, [("r1",) + (None,) * 13])
    out = V.request_features(req, _stats(spark)).first().asDict()
    assert out["UniqueCarrier"] == "WN" and out["Origin"] == "ORD" and out["Dest"] == "LAX"
    assert out["DepHour"] == 12 and out["TimeOfDay"] == "Afternoon"
    assert out["Distance"] == 1000 and out["DistanceCategory"] == "Medium"
    assert out["IsWeekend"] == 0 and out["DayOfWeek"] == 1 and out["Day"] == 15
    # lookups use the raw (missing) values: every statistic misses
    assert out["AvgCarrierDelay"] == 60.0 and out["AvgHourDelay"] == 55.0
    assert out["AvgRouteDelay"] == 58.0 and out["AvgOriginDelay"] == 57.0
    assert out["AvgDestDelay"] == 57.0 and out["AvgCarrierHourDelay"] == 58.0
    assert out["CarrierFlightCount"] == 10000 and out["RouteFlightCount"] == 5000
    assert out["DepDelay"] == 0.0 and out["TaxiOut"] == 15 and out["model_type"] == "A"


def test_lookup_hits(spark):
    req = _requests(spark, [("r1", "B", "AA", "ORD", "LAX", 1745, 14, 6, 12, 15, 240, 18, 5.0, 20)])
    out = V.request_features(req, _stats(spark)).first().asDict()
    assert (out["AvgCarrierDelay"], out["AvgHourDelay"], out["AvgRouteDelay"], out["AvgOriginDelay"],
            out["AvgDestDelay"], out["AvgCarrierHourDelay"]) == (10.0, 20.0, 30.0, 40.0, 50.0, 70.0)
    assert out["IsWeekend"] == 1 and out["IsRushHour"] == 0 and out["DistanceCategory"] == "Long"


def test_requests_without_id_are_skipped(spark):
    req = _requests(spark, [(None,) + (None,) * 13, ("",) + (None,) * 13, ("ok",) + (None,) * 13])
    assert [r.request_id for r in V.valid_requests(req).collect()] == ["ok"]


def test_malformed_json_is_dropped(spark):
    df = spark.createDataFrame([('{"request_id": "a", "DepHour": 3}',), ("not json{",), ('{"DepHour": 4}',)],
                               "value string")
    parsed = df.select(parse_request_json(F.col("value")).alias("r")).select("r.*")
    got = V.valid_requests(parsed).collect()
    assert [(r.request_id, r.DepHour) for r in got] == [("a", 3)]


def test_distance_lookup_reverse_zero_missing(spark):
    dist = spark.createDataFrame([("A", "B", 700), ("C", "D", 0), ("E", "F", 300), ("F", "E", 999)],
                                 "Origin string, Dest string, Distance int")
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("X", "Y"), ("E", "F")],
                                  "Origin string, Dest string")
    got = {(r.Origin, r.Dest): (r.found, r.distance) for r in V.distance_lookup(pairs, dist).collect()}
    assert got[("A", "B")] == (True, 700)
    assert got[("B", "A")] == (True, 700)       # reverse key
    assert got[("C", "D")] == (False, 1000)     # stored 0 counts as not found
    assert got[("X", "Y")] == (False, 1000)
    assert got[("E", "F")] == (True, 300)       # forward wins over reverse


def test_merge_both_one_none_error_and_first_match(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    s = dt.timedelta(seconds=1)
    req = spark.createDataFrame([("a", t0), ("b", t0), ("c", t0), ("d", t0)], "request_id string, ts timestamp")
    reg = spark.createDataFrame([("a", t0 + 2 * s, 1.0, "success"), ("a", t0 + 3 * s, 9.0, "success"),
                                 ("b", t0 + 11 * s, 2.0, "success"), ("c", t0 + 1 * s, None, "error")],
                                "request_id string, ts timestamp, predicted_delay_minutes double, status string")
    cls = spark.createDataFrame([("a", t0 + 5 * s, 10.0, 5.0, "success"), ("b", t0 + 10 * s, 20.0, 1.0, "success")],
                                "request_id string, ts timestamp, probability_over_30min double, "
                                "probability_over_60min double, status string")
    reg = reg.withColumn("model_type", F.lit("A")).withColumn("error", F.when(F.col("status") == "error", "bad"))
    got = {r.request_id: r for r in V.merged_response(req, reg, cls).collect()}
    assert got["a"].regression_model_type == "A" and got["c"].regression_error == "bad"
    assert got["a"].status == "success" and got["a"].predicted_delay_minutes == 1.0   # first answer
    assert got["b"].status == "partial" and got["b"].regression_status is None      # 11 s: too late
    assert got["c"].status == "partial" and got["c"].regression_status == "error"   # error counts
    assert got["d"].status == "timeout"


def test_validation_rule(spark):
    req = spark.createDataFrame(
        [("1", "AA", "ORD", "LAX", 100, 12, 60), ("2", "AA", "ORD", "ORD", 100, 12, 60),
         ("3", "AA", "ORD", "LAX", 100, 12, 9), ("4", None, "ORD", "LAX", 100, 12, 60),
         ("5", "AA", "", "LAX", 100, 12, 60)],
        "request_id string, UniqueCarrier string, Origin string, Dest string, Distance int, DepHour int, CRSElapsedTime int")
    got = {r.request_id: r.is_valid for r in V.request_validation(req).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": False, "5": False}


def test_first_answer_inside_the_window_wins(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    s = dt.timedelta(seconds=1)
    req = spark.createDataFrame([("a", t0), ("b", t0), ("c", t0)], "request_id string, ts timestamp")
    reg = spark.createDataFrame(
        [("a", t0 + 5 * s, 99.0, "success"), ("a", t0 + 2 * s, 1.0, "success"), ("a", t0 - 3 * s, 7.0, "success"),
         ("b", t0 - 1 * s, 5.0, "success"), ("c", t0 + 4 * s, 8.0, "success"), ("c", t0 + 4 * s, 3.0, "success")],
        "request_id string, ts timestamp, predicted_delay_minutes double, status string")
    got = {r.request_id: r for r in V.request_response_join(req, reg).collect()}
    assert got["a"].predicted_delay_minutes == 1.0     # the later one first in the table, an early stray
    assert got["b"].status == "timeout"                # answered before it was asked
    assert got["c"].predicted_delay_minutes == 3.0     # same time: smallest values
    cls = spark.createDataFrame([("a", t0 + s, 10.0, 5.0, "success")],
                                "request_id string, ts timestamp, probability_over_30min double, "
                                "probability_over_60min double, status string")
    one = {r.request_id: r for r in V.request_response_join(req, cls, "classification").collect()}
    assert one["a"].probability_over_30min == 10.0 and one["b"].status == "timeout"


def test_no_answer_has_no_band(spark):
    from tardy.functions import bands as B
    r = spark.createDataFrame([(None,)], "x double").select(B.severity_band("x").alias("s"), B.risk_band("x").alias("r")).first()
    assert r.s is None and r.r is None
