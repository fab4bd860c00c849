"""Explicit schemas: never infer types from CSV/JSON (inference is a second pass)."""

from pyspark.sql import types as T

FLIGHT_SCHEMA = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("DepTime", T.IntegerType()),
    T.StructField("ArrTime", T.IntegerType()),
    T.StructField("CRSArrTime", T.IntegerType()),
    T.StructField("UniqueCarrier", T.StringType()),
    T.StructField("FlightNum", T.IntegerType()),
    T.StructField("Origin", T.StringType()),
    T.StructField("Dest", T.StringType()),
    T.StructField("Distance", T.IntegerType()),
    T.StructField("CRSElapsedTime", T.IntegerType()),
    T.StructField("ActualElapsedTime", T.IntegerType()),
    T.StructField("AirTime", T.IntegerType()),
    T.StructField("TaxiIn", T.IntegerType()),
    T.StructField("TaxiOut", T.IntegerType()),
    # kept as text: the cleaning step casts with try_cast (bad value -> null)
    T.StructField("DepDelay", T.StringType()),
    T.StructField("ArrDelay", T.StringType()),
    T.StructField("Cancelled", T.IntegerType()),
    T.StructField("Diverted", T.IntegerType()),
    T.StructField("CancellationCode", T.StringType()),
    T.StructField("CarrierDelay", T.IntegerType()),
    T.StructField("WeatherDelay", T.IntegerType()),
    T.StructField("NASDelay", T.IntegerType()),
    T.StructField("SecurityDelay", T.IntegerType()),
    T.StructField("LateAircraftDelay", T.IntegerType()),
])

# Scoring request.  Any field may be missing; a JSON null is treated as
# missing (from_json cannot tell them apart).
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("UniqueCarrier", T.StringType()),
    T.StructField("Origin", T.StringType()),
    T.StructField("Dest", T.StringType()),
    T.StructField("Distance", T.IntegerType()),
    T.StructField("DepHour", T.IntegerType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("Day", T.IntegerType()),
    T.StructField("CRSElapsedTime", T.IntegerType()),
    T.StructField("CRSArrHour", T.IntegerType()),
    T.StructField("DepDelay", T.DoubleType()),
    T.StructField("TaxiOut", T.IntegerType()),
])

REGRESSION_RESPONSE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("predicted_delay_minutes", T.DoubleType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

CLASSIFICATION_RESPONSE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("probability_over_30min", T.DoubleType()),
    T.StructField("probability_over_60min", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

ANSWER_SCHEMAS = {"regression": REGRESSION_RESPONSE_SCHEMA, "classification": CLASSIFICATION_RESPONSE_SCHEMA}

# A message as a file topic keeps it; a broker adds the time itself.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
