"""The trip table.

``read_flights_csv`` reads the original CSV layout with an explicit schema.
``flights_view`` derives a trip table of the same shape from the star-schema
test tables (line items are trips; supplier nation = origin, customer nation
= destination).  Every column is a deterministic expression of the source
row, so the view grows with the tables.

Join strategy: no hints.  Spark sizes the raw scans from file statistics
(``autoBroadcastJoinThreshold``) and AQE re-plans from shuffle sizes, so
small dimension tables are broadcast locally and all joins become
sort-merge joins at cluster scale.  Orders meet their customers first, so
that the line items, the largest side, are shuffled by order only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import FLIGHT_SCHEMA
from .tables import read_table


def read_flights_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row and the declared schema (no inference pass)."""
    return (spark.read.schema(FLIGHT_SCHEMA)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .csv(path))


def _int(c: Column) -> Column:
    return c.cast("int")


def _two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def flights_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_returnflag", "l_shipdate")
    # dimension sides are sized by Spark from their files
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    placed = orders.join(cust, F.col("o_custkey") == cust.c_custkey).select("o_orderkey", "c_nationkey")
    j = (li.join(placed, li.l_orderkey == placed.o_orderkey)
           .join(supp, li.l_suppkey == supp.s_suppkey))

    ok, pk, sk, ln = (F.col("l_orderkey"), F.col("l_partkey"),
                      F.col("l_suppkey"), F.col("l_linenumber"))
    sn, cn, qty = F.col("s_nationkey"), F.col("c_nationkey"), F.col("l_quantity")
    rf = F.col("l_returnflag")
    cancelled = (rf == "R") & (ln == 1)
    diverted = (rf == "A") & (ln == 2)

    return j.select(
        F.concat(_two_digits(F.dayofmonth("l_shipdate")), F.lit("-"),
                 _two_digits(F.month("l_shipdate")), F.lit("-"),
                 F.year("l_shipdate").cast("string")).alias("Date"),
        _int(1 + ok % 7).alias("DayOfWeek"),
        _int(F.when(ok % 101 == 0, None)
             .otherwise(((ok + ln) % 25) * 100 + pk % 60)).alias("DepTime"),
        _int(((ok + 5) % 24) * 100 + sk % 60).alias("ArrTime"),
        _int(((ok + 3) % 24) * 100 + sk % 60).alias("CRSArrTime"),
        F.concat(F.lit("C"), (sk % 12).cast("string")).alias("UniqueCarrier"),
        _int(ok % 9999).alias("FlightNum"),
        F.when(ok % 103 == 0, None)
         .otherwise(F.concat(F.lit("N"), sn.cast("string"))).alias("Origin"),
        F.concat(F.lit("N"), cn.cast("string")).alias("Dest"),
        _int(100 + ((sn * 13 + cn * 29) % 30) * 100
             + F.when(ln == 7, 1).otherwise(0)).alias("Distance"),
        _int(40 + pk % 300).alias("CRSElapsedTime"),
        _int(25 + pk % 300 + sk % 41).alias("ActualElapsedTime"),
        _int(pk % 300 - 5).alias("AirTime"),
        _int(3 + ln).alias("TaxiIn"),
        _int(5 + pk % 40).alias("TaxiOut"),
        F.when(ok % 97 == 0, None).otherwise(qty * 4 - 60).alias("DepDelay"),
        F.when(ok % 89 == 0, None)
         .otherwise(qty * 4 - 60 + ln * 3 + sn % 5).alias("ArrDelay"),
        F.when(cancelled, 1).otherwise(0).alias("Cancelled"),
        F.when(diverted, 1).otherwise(0).alias("Diverted"),
        F.when(cancelled, F.lit("A")).alias("CancellationCode"),
        _int(ln).alias("CarrierDelay"),
        _int(sk % 3).alias("WeatherDelay"),
        _int(pk % 7).alias("NASDelay"),
        F.lit(0).alias("SecurityDelay"),
        _int(ok % 11).alias("LateAircraftDelay"),
    )
