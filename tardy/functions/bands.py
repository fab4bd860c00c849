"""Request-form rules and answer bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def leading_int(text) -> Column:
    """Leading integer of a text like a lenient integer parser: optional
    blanks and sign, then digits; anything else -> null."""
    digits = F.regexp_extract(_c(text), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def int_or_default(text, default: int) -> Column:
    """Parse-or-default where zero also counts as missing."""
    return F.coalesce(F.nullif(leading_int(text), F.lit(0)), F.lit(default))


def split_hhmm(text) -> tuple[Column, Column]:
    parts = F.split(_c(text), ":")
    return parts.getItem(0).try_cast("int"), parts.getItem(1).try_cast("int")


def arrival_hour(dep_hour, dep_minute, duration) -> Column:
    """floor(((h*60 + m + duration) / 60) mod 24) with a fractional modulo."""
    total = _c(dep_hour) * 60 + _c(dep_minute) + _c(duration)
    return F.floor((total / 60) % 24).cast("int")


def severity_band(minutes) -> Column:
    on_time, delayed, critical = K.SEVERITY_LABELS
    m = _c(minutes)
    return (F.when(m.isNull(), F.lit(None).cast("string"))  # no answer, no band
             .when(m <= K.SEVERITY_ON_TIME_UPTO, on_time)
             .when(m <= K.SEVERITY_DELAYED_UPTO, delayed)
             .otherwise(critical))


def signed_minutes_text(minutes) -> Column:
    """'+37.5 min' / '-3 min': sign for positive values, whole numbers
    without a decimal part."""
    m = _c(minutes)
    num = F.regexp_replace(m.cast("string"), r"\.0$", "")
    return F.concat(F.when(m > 0, "+").otherwise(""), num, F.lit(" min"))


def risk_band(percent) -> Column:
    low, medium, high = K.RISK_LABELS
    p = _c(percent)
    return (F.when(p.isNull(), F.lit(None).cast("string"))
             .when(p < K.RISK_LOW_BELOW, low)
             .when(p < K.RISK_MEDIUM_BELOW, medium)
             .otherwise(high))


def percent_text(percent) -> Column:
    p = _c(percent)
    return F.when(p.isNotNull(), F.format_string("%.1f%%", p))
