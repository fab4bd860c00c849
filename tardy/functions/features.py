"""One definition of each derived column, used by training and serving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of(hhmm) -> Column:
    """hhmm integer -> hour, truncating (2400 -> 24)."""
    return (_c(hhmm) / 100).cast("int")


def hour_floor(hhmm) -> Column:
    """hhmm integer -> hour via floor; bigint like the training data."""
    return F.floor(_c(hhmm) / 100)


def parse_date(c) -> Column:
    """dd-MM-yyyy text -> date; malformed -> null (ANSI-safe)."""
    return F.try_to_date(_c(c), K.DATE_PATTERN)


def is_weekend(day_of_week) -> Column:
    return F.when(_c(day_of_week).isin(K.WEEKEND_DAYS), 1).otherwise(0)


def is_rush_hour(hour) -> Column:
    h = _c(hour)
    cond = None
    for lo, hi in K.RUSH_HOUR_RANGES:
        part = h.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return F.when(cond, 1).otherwise(0)


def time_of_day(hour) -> Column:
    """Bands of the departure hour; null and 24 fall to Night."""
    h = _c(hour)
    expr = None
    for label, lo, hi in K.TIME_OF_DAY_BANDS:
        expr = (F.when(h.between(lo, hi), label) if expr is None
                else expr.when(h.between(lo, hi), label))
    return expr.otherwise(K.TIME_OF_DAY_OTHER)


def distance_category(distance) -> Column:
    """Short / Medium / Long; null falls to Long."""
    d = _c(distance)
    short, medium, long_ = K.DISTANCE_LABELS
    return (F.when(d < K.DISTANCE_SHORT_BELOW, short)
             .when(d.between(K.DISTANCE_SHORT_BELOW, K.DISTANCE_MEDIUM_UPTO), medium)
             .otherwise(long_))


def route_key(origin="Origin", dest="Dest") -> Column:
    """Origin-Dest skipping nulls (concat_ws)."""
    return F.concat_ws("-", _c(origin), _c(dest))


def route_key_strict(origin="Origin", dest="Dest") -> Column:
    """Origin-Dest, null if either side is null (concat)."""
    return F.concat(_c(origin), F.lit("-"), _c(dest))


def delay_label(threshold: int, delay="ArrDelay") -> Column:
    """1 if the delay is strictly above the threshold, else 0 (null -> 0)."""
    return F.when(_c(delay) > threshold, 1).otherwise(0)


def speed_mph(distance="Distance", air_time="AirTime") -> Column:
    return _c(distance) / (_c(air_time) / 60)


def day_name(day_of_week="DayOfWeek") -> Column:
    pairs = []
    for k, v in K.DAY_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(day_of_week))


def calendar_and_time_features() -> dict[str, Column]:
    """Derived trip columns (Date must already be parsed, see
    ``with_calendar_and_time``)."""
    return {
        "Month": F.month("Date"),
        "Day": F.dayofmonth("Date"),
        "DepHour": hour_of("DepTime"),
        "ArrHour": hour_of("ArrTime"),
        "IsWeekend": is_weekend("DayOfWeek"),
        "TaxiTotal": F.col("TaxiIn") + F.col("TaxiOut"),
        "ScheduledFlightTime": F.col("CRSElapsedTime"),
        "ActualFlightTime": F.col("ActualElapsedTime"),
        "FlightTimeDiff": F.col("ActualElapsedTime") - F.col("CRSElapsedTime"),
        "CRSArrHour": hour_floor("CRSArrTime"),
    }


def with_calendar_and_time(df):
    """Parse the date once (its own projection: Spark does not inline a
    non-trivial aliased expression into several uses), then derive the
    calendar, hour and duration columns from it."""
    return df.withColumn("Date", parse_date("Date")).withColumns(calendar_and_time_features())


def band_features() -> dict[str, Column]:
    return {
        "TimeOfDay": time_of_day("DepHour"),
        "DistanceCategory": distance_category("Distance"),
        "Route": route_key("Origin", "Dest"),
    }
