"""Serving side on whole request tables (batch) or streams.

Requests are scored as a table, never one row per job: defaults for
missing fields, statistic lookups (broadcast, size-checked), the route
distance lookup, and the request/response joins with a deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import constants as K
from ..functions import features as X
from ..plans.sizing import salted_left_join

DEFAULTED = ["DayOfWeek", "Month", "Day", "DepHour", "Distance", "CRSElapsedTime",
             "CRSArrHour", "UniqueCarrier", "Origin", "Dest", "DepDelay", "TaxiOut",
             "model_type"]


def tag_requests(df: DataFrame) -> DataFrame:
    """Give every incoming request a fresh random id.  uuid() is
    non-deterministic: persist or write the tagged table before using it
    twice (a recomputed task would draw new ids)."""
    return df.withColumn("request_id", F.expr("uuid()"))


def valid_requests(df: DataFrame) -> DataFrame:
    """Messages without a request id (null or empty) are skipped."""
    return df.filter(F.coalesce(F.length("request_id"), F.lit(0)) > 0)


def lookup_statistics(req: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Left joins of the raw request values against the six statistics;
    a miss (including a missing field) takes the serving default.  In a
    stream a statistic that is not broadcast is joined with salted keys."""
    large = getattr(stats, "large", set())

    def look(rows: DataFrame, name: str, keys: list[str], table: DataFrame) -> DataFrame:
        if name in large and rows.isStreaming:
            return salted_left_join(rows, table, keys)
        return rows.join(table, keys, "left")

    r = req.withColumn("_route", X.route_key_strict("Origin", "Dest"))
    r = look(r, "carrier_stats", ["UniqueCarrier"], stats["carrier_stats"].select("UniqueCarrier", "AvgCarrierDelay"))
    r = look(r, "hour_stats", ["DepHour"], stats["hour_stats"])
    r = look(r, "route_stats", ["_route"], stats["route_stats"].select(F.col("Route").alias("_route"), "AvgRouteDelay"))
    r = look(r, "origin_stats", ["Origin"], stats["origin_stats"])
    r = look(r, "dest_stats", ["Dest"], stats["dest_stats"])
    r = look(r, "carrier_hour_stats", ["UniqueCarrier", "DepHour"], stats["carrier_hour_stats"])
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in K.LOOKUP_MISS_DEFAULTS.items()}
    return r.drop("_route").withColumns(filled)


def request_features(req: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Model-ready request rows: lookups on raw values, then defaults.

    IsWeekend reads the raw day (missing -> 0); the time-of-day, distance
    band and rush-hour flag read the defaulted values; the two counts are
    constants when serving.
    """
    looked = lookup_statistics(valid_requests(req), stats)
    raw_day = F.col("DayOfWeek")
    out = looked.withColumn("IsWeekend", X.is_weekend(raw_day))
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(K.REQUEST_DEFAULTS[c])) for c in DEFAULTED})
    return out.select(
        "request_id", "model_type",
        *K.CATEGORICAL_FEATURES[:3],
        X.time_of_day("DepHour").alias("TimeOfDay"),
        X.distance_category("Distance").alias("DistanceCategory"),
        "DayOfWeek", "Month", "Day", "DepHour", "IsWeekend",
        X.is_rush_hour("DepHour").alias("IsRushHour"),
        "Distance", "CRSElapsedTime", F.col("CRSArrHour").cast("bigint").alias("CRSArrHour"),
        *K.AVERAGE_COLUMNS,
        F.lit(K.SERVING_CARRIER_FLIGHT_COUNT).cast("bigint").alias("CarrierFlightCount"),
        F.lit(K.SERVING_ROUTE_FLIGHT_COUNT).cast("bigint").alias("RouteFlightCount"),
        F.col("DepDelay").cast("double").alias("DepDelay"), "TaxiOut",
    )


def distance_lookup(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Forward route, else reverse route, else not found (1000).  A stored
    distance of 0 counts as not found."""
    fwd = distances.select("Origin", "Dest", F.col("Distance").alias("_fwd"))
    rev = distances.select(F.col("Origin").alias("Dest"), F.col("Dest").alias("Origin"),
                           F.col("Distance").alias("_rev"))
    j = pairs.join(fwd, ["Origin", "Dest"], "left").join(rev, ["Origin", "Dest"], "left")
    d = F.coalesce(F.col("_fwd"), F.col("_rev"))
    found = d.isNotNull() & (d != 0)
    return j.select(*pairs.columns, found.alias("found"),
                    F.when(found, d).otherwise(F.lit(K.DISTANCE_NOT_FOUND)).alias("distance"))


# Fields of an answer of each kind, besides its id and time.
ANSWER_FIELDS = {
    "regression": {"status": "string", "error": "string", "model_type": "string",
                   "predicted_delay_minutes": "double"},
    "classification": {"status": "string", "error": "string", "probability_over_30min": "double",
                       "probability_over_60min": "double"},
}
_SHARED = ("status", "error", "model_type")


def _named(kind: str, field: str) -> str:
    return f"{kind}_{field}" if field in _SHARED else field


def tagged_answers(responses: dict[str, DataFrame]) -> DataFrame:
    """The answers of all kinds in one table: answer_id, answer_ts, and a
    struct per kind (null for the other kinds)."""
    out = None
    for kind, df in responses.items():
        structs = []
        for other, fields in ANSWER_FIELDS.items():
            if other in responses:
                whole = F.struct(*[(F.col(f).cast(t) if f in df.columns else F.lit(None).cast(t)).alias(f)
                                   for f, t in fields.items()])
                structs.append((whole if other == kind else _null_struct(fields)).alias(other))
        part = df.select(F.col("request_id").alias("answer_id"), F.col("ts").alias("answer_ts"), *structs)
        out = part if out is None else out.unionByName(part)
    return out


def _null_struct(fields: dict[str, str]):
    return F.lit(None).cast("struct<" + ",".join(f"{f}:{t}" for f, t in fields.items()) + ">")


def first_answers(req: DataFrame, answers: DataFrame, kinds: list[str],
                  deadline: int = K.RESPONSE_DEADLINE_SECONDS) -> DataFrame:
    """One row per request with the whole first answer of each kind, or
    null.  Only answers from the request's time to the deadline count; of
    those the earliest wins (ties: smallest status, then smallest values).

    The same plan serves tables and streams (with watermarks on ``ts`` and
    ``answer_ts``): a join bounded in time, then one aggregate per request,
    so repeated answers are reduced before the shuffle of the aggregate.
    """
    near = F.expr(f"request_id = answer_id AND answer_ts >= ts "
                  f"AND answer_ts <= ts + INTERVAL {int(deadline)} SECONDS")
    joined = req.join(answers, near, "leftOuter")
    # a kind's order is null for rows of other kinds, which min_by ignores
    first = [F.min_by(F.col(k), F.when(F.col(k).isNotNull(), F.struct(
        "answer_ts", *[F.col(k)[f] for f in ("status", *[x for x in ANSWER_FIELDS[k] if x != "status"])])))
        .alias(k) for k in kinds]
    return joined.groupBy("request_id", "ts").agg(*first)


def answer_columns(first: DataFrame, kinds: list[str], *extra) -> DataFrame:
    """request_id, status, ``extra`` and every answer's fields as columns.  All kinds
    answered -> success; some -> partial; none -> timeout.  An answer whose
    own status is error still counts as an answer."""
    has = [F.col(k).isNotNull() for k in kinds]
    every, some = has[0], has[0]
    for h in has[1:]:
        every, some = every & h, some | h
    status = F.when(every, "success").when(some, "partial").otherwise("timeout")
    return first.select("request_id", status.alias("status"), *extra, *[
        F.col(k)[f].alias(_named(k, f)) for k in kinds for f in ANSWER_FIELDS[k]])


def request_response_join(req: DataFrame, responses: DataFrame, kind: str = "regression",
                          deadline: int = K.RESPONSE_DEADLINE_SECONDS) -> DataFrame:
    """One model kind: success with the whole answer, or timeout."""
    base = valid_requests(req).select("request_id", "ts")
    return answer_columns(first_answers(base, tagged_answers({kind: responses}), [kind], deadline), [kind])


def merged_response(req: DataFrame, regression: DataFrame, classification: DataFrame,
                    deadline: int = K.RESPONSE_DEADLINE_SECONDS) -> DataFrame:
    """Both kinds, each answer whole: success, partial or timeout."""
    base = valid_requests(req).select("request_id", "ts")
    answers = tagged_answers({"regression": regression, "classification": classification})
    return answer_columns(first_answers(base, answers, list(ANSWER_FIELDS), deadline), list(ANSWER_FIELDS))


def request_validation(req: DataFrame) -> DataFrame:
    """Form rule: carrier, origin, destination set, origin != destination,
    distance and hour present, duration at least the minimum."""
    def present(c):
        return F.coalesce(F.length(c), F.lit(0)) > 0
    ok = (present("UniqueCarrier") & present("Origin") & present("Dest")
          & (F.col("Origin") != F.col("Dest"))
          & F.col("Distance").isNotNull() & F.col("DepHour").isNotNull()
          & (F.col("CRSElapsedTime") >= K.FORM_MIN_DURATION))
    return req.select("request_id", "UniqueCarrier", "Origin", "Dest", "CRSElapsedTime",
                      F.coalesce(ok, F.lit(False)).alias("is_valid"))


def round_outputs(regression: DataFrame, classification: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minutes to 2 decimals, percents to 1 (HALF_UP)."""
    r = regression.withColumn("predicted_delay_minutes", F.round("predicted_delay_minutes", 2))
    c = classification.withColumns({p: F.round(p, 1) for p in
                                    ("probability_over_30min", "probability_over_60min")})
    return r, c


def answer_bands(merged: DataFrame) -> DataFrame:
    """Severity of the delay and risk bands of the two probabilities."""
    m = F.col("predicted_delay_minutes")
    return merged.select(
        "request_id", "status",
        B.severity_band(m).alias("severity"), B.signed_minutes_text(m).alias("delay_text"),
        B.risk_band("probability_over_30min").alias("risk_30"),
        B.risk_band("probability_over_60min").alias("risk_60"),
        B.percent_text("probability_over_30min").alias("p30_text"),
        B.percent_text("probability_over_60min").alias("p60_text"))


def form_to_request(form: DataFrame) -> DataFrame:
    """Request fields from the raw form text: parse-or-default (zero is
    missing), arrival hour from departure time plus duration, fixed day."""
    h, m = B.split_hhmm("dep_time")
    duration = B.int_or_default("duration_text", K.FORM_DEFAULT_DURATION)
    return form.select(
        "request_id", h.alias("DepHour"), m.alias("DepMinute"),
        duration.alias("CRSElapsedTime"),
        B.arrival_hour(h, m, duration).alias("CRSArrHour"),
        B.int_or_default("distance_text", K.FORM_DEFAULT_DISTANCE).alias("Distance"),
        B.int_or_default("dep_delay_text", K.FORM_DEFAULT_DEP_DELAY).alias("DepDelay"),
        B.int_or_default("taxi_out_text", K.FORM_DEFAULT_TAXI_OUT).alias("TaxiOut"),
        F.lit(K.FORM_FIXED_DAY).alias("Day"))
