"""Scoring requests and model responses.

Batch: ``read_request_batch`` reads JSON request bodies with the declared
schema.  Test views: ``requests_view`` turns every event into a request;
``regression_responses_view`` / ``classification_responses_view`` turn the
same events into model answers with a per-request latency.  Every event
gets an answer row; answers that a model never delivered in time carry a
latency far beyond the deadline (so they count as missing), which keeps the
response tables whole instead of filtering rows out.  Some requests get a
second answer (at the same time or later) and some a stray one from before
the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import REQUEST_SCHEMA
from .tables import read_table

# Extra latency of an answer that was lost (beyond any deadline).
LOST_ANSWER_SECONDS = 3600


def read_request_batch(spark: SparkSession, path: str) -> DataFrame:
    """JSON request bodies (one object per line), declared schema."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def parse_request_json(value: Column) -> Column:
    """Decode a JSON request body; malformed input gives a struct of nulls."""
    return F.from_json(value, REQUEST_SCHEMA, {"mode": "PERMISSIVE"})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return _events(spark, sf_dir).select(
        F.when(e % 50 == 0, F.lit(None).cast("string"))
         .when(e % 51 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("r"), e.cast("string"))).alias("request_id"),
        "ts",
        F.when(u % 3 == 0, "B").when(u % 3 == 1, "A").alias("model_type"),
        F.when(u % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C"), (u % 14).cast("string"))).alias("UniqueCarrier"),
        F.concat(F.lit("N"), (u % 25).cast("string")).alias("Origin"),
        F.concat(F.lit("N"), (e % 27).cast("string")).alias("Dest"),
        F.when(e % 9 == 0, F.lit(None).cast("int"))
         .otherwise((e % 3000).cast("int")).alias("Distance"),
        F.when(e % 8 == 0, F.lit(None).cast("int"))
         .otherwise((e % 24).cast("int")).alias("DepHour"),
        (1 + e % 7).cast("int").alias("DayOfWeek"),
        (1 + e % 12).cast("int").alias("Month"),
        F.lit(15).cast("int").alias("Day"),
        (30 + u % 300).cast("int").alias("CRSElapsedTime"),
        ((e + 3) % 24).cast("int").alias("CRSArrHour"),
        (F.col("value") - 20).alias("DepDelay"),
        (u % 30).cast("int").alias("TaxiOut"),
    )


def _answer_ts(latency_mod: int, lost_mod: int) -> Column:
    e = F.col("event_id")
    seconds = (e % latency_mod).cast("int") + F.when(
        e % lost_mod == 1, LOST_ANSWER_SECONDS).otherwise(0)
    return F.col("ts") + F.make_interval(secs=seconds)


# Kinds of answer rows: the answer itself, a repeated one, a stray early one.
_MAIN, _REPEATED, _EARLY = 0, 1, 2


def _with_strays(events: DataFrame) -> DataFrame:
    """One row per answer message of an event, its kind in ``k``."""
    e = F.col("event_id")
    kinds = F.array_compact(F.array(
        F.lit(_MAIN), F.when(e % 10 == 3, F.lit(_REPEATED)), F.when(e % 14 == 5, F.lit(_EARLY))))
    return events.withColumn("k", F.explode(kinds))


def _sent(ts: Column) -> Column:
    """Repeated answers come 0 to 2 s after the first, early ones 2 s before
    the request."""
    later = F.make_interval(secs=(F.col("event_id") % 3).cast("int"))
    return (F.when(F.col("k") == _EARLY, F.col("ts") - F.make_interval(secs=F.lit(2)))
             .when(F.col("k") == _REPEATED, ts + later).otherwise(ts))


def regression_responses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _with_strays(_events(spark, sf_dir)).select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        _sent(_answer_ts(13, 4)).alias("ts"),
        (F.col("value") + 100 * F.col("k")).alias("predicted_delay_minutes"),
        F.when(F.col("user_id") % 3 == 0, "B").otherwise("A").alias("model_type"),
        F.when(e % 20 == 0, "error").otherwise("success").alias("status"),
        F.when(e % 20 == 0, "invalid feature value").alias("error"),
    )


def classification_responses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _with_strays(_events(spark, sf_dir)).select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        _sent(_answer_ts(12, 6)).alias("ts"),
        ((e % 1000).cast("double") / 10).alias("probability_over_30min"),
        (((e + F.col("k")) % 700).cast("double") / 10).alias("probability_over_60min"),
        F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def form_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text fields as a request form sends them (departure time as
    HH:MM, free-text numbers that may be empty, zero or trail junk)."""
    e, u = F.col("event_id"), F.col("user_id")
    dur = (30 + u % 300).cast("string")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        F.concat(F.lpad((e % 24).cast("string"), 2, "0"), F.lit(":"),
                 F.lpad((u % 60).cast("string"), 2, "0")).alias("dep_time"),
        F.when(e % 17 == 0, F.lit("")).when(e % 19 == 0, F.concat(dur, F.lit("abc")))
         .when(e % 23 == 0, F.lit("0")).otherwise(dur).alias("duration_text"),
        F.when(e % 9 == 0, F.lit("n/a")).when(e % 11 == 0, F.concat(F.lit(" "), (e % 3000).cast("string")))
         .otherwise((e % 3000).cast("string")).alias("distance_text"),
        F.floor(F.col("value") - 20).cast("string").alias("dep_delay_text"),
        (u % 30).cast("string").alias("taxi_out_text"),
    )
