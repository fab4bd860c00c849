"""Edge tables for the derived columns."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tardy.functions import bands as B
from tardy.functions import features as X


def test_hours_and_bands(spark):
    df = spark.createDataFrame([(2400,), (None,), (559,), (600,), (1159,), (1200,), (1759,),
                                (1800,), (2159,), (2200,)], "DepTime int")
    out = df.select(X.hour_of("DepTime").alias("h")).select(
        "h", X.time_of_day("h").alias("tod"), X.is_rush_hour("h").alias("rush")).collect()
    got = [(r.h, r.tod, r.rush) for r in out]
    assert got == [(24, "Night", 0), (None, "Night", 0), (5, "Night", 0), (6, "Morning", 1),
                   (11, "Morning", 0), (12, "Afternoon", 0), (17, "Afternoon", 1),
                   (18, "Evening", 1), (21, "Evening", 0), (22, "Night", 0)]


def test_floor_hour_is_bigint(spark):
    df = spark.createDataFrame([(2359,)], "t int").select(X.hour_floor("t").alias("h"))
    assert df.schema["h"].dataType.simpleString() == "bigint"
    assert df.first().h == 23


def test_distance_category(spark):
    df = spark.createDataFrame([(499,), (500,), (1500,), (1501,), (None,)], "d int")
    got = [r.c for r in df.select(X.distance_category("d").alias("c")).collect()]
    assert got == ["Short", "Medium", "Medium", "Long", "Long"]


def test_route_keys_and_nulls(spark):
    df = spark.createDataFrame([("A", "B"), (None, "B"), ("A", None)], "o string, d string")
    got = df.select(X.route_key("o", "d").alias("r"), X.route_key_strict("o", "d").alias("s")).collect()
    assert [(r.r, r.s) for r in got] == [("A-B", "A-B"), ("B", None), ("A", None)]


def test_dates_labels_weekend(spark):
    df = spark.createDataFrame([("03-01-2019", 6, 30.0), ("2019-01-03", 7, 30.5), ("bad", 1, None)],
                               "Date string, DayOfWeek int, ArrDelay double")
    out = df.select(X.parse_date("Date").alias("d"), X.is_weekend("DayOfWeek").alias("w"),
                    X.delay_label(30).alias("l30")).collect()
    assert str(out[0].d) == "2019-01-03" and out[1].d is None and out[2].d is None
    assert [r.w for r in out] == [1, 1, 0]
    assert [r.l30 for r in out] == [0, 1, 0]


def test_form_parsing(spark):
    df = spark.createDataFrame([("120",), ("",), ("12abc",), ("0",), (" 42",), ("-5",), ("x9",)],
                               "t string")
    got = [r.v for r in df.select(B.int_or_default("t", 15).alias("v")).collect()]
    assert got == [120, 15, 12, 15, 42, -5, 15]


def test_arrival_hour_wraps(spark):
    df = spark.createDataFrame([Row(h=23, m=30, d=90), Row(h=0, m=0, d=0), Row(h=22, m=59, d=61)])
    got = [r.a for r in df.select(B.arrival_hour("h", "m", "d").alias("a")).collect()]
    assert got == [1, 0, 0]


def test_bands(spark):
    df = spark.createDataFrame([(15.0,), (15.01,), (45.0,), (45.5,), (-3.0,), (40.0,)], "m double")
    out = df.select(B.severity_band("m").alias("b"), B.signed_minutes_text("m").alias("t")).collect()
    assert [r.b for r in out] == ["on_time", "delayed", "delayed", "critical", "on_time", "delayed"]
    assert [r.t for r in out] == ["+15 min", "+15.01 min", "+45 min", "+45.5 min", "-3 min", "+40 min"]
    p = spark.createDataFrame([(24.9,), (25.0,), (49.99,), (50.0,)], "p double")
    assert [r.b for r in p.select(B.risk_band("p").alias("b")).collect()] == ["low", "medium", "medium", "high"]
    assert p.select(B.percent_text(F.lit(42.25)).alias("t")).first().t == "42.3%"
