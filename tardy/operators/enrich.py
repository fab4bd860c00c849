"""Enrich trips with their group statistics (left joins, misses -> 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as X
from ..plans.sizing import materialize
from .stats import SPEC_BY_NAME, compute_stats, single_stat

ENRICH_ORDER = ["carrier_stats", "hour_stats", "route_stats",
                "origin_stats", "dest_stats", "carrier_hour_stats"]


def enrich_one(df: DataFrame, stat: DataFrame, name: str) -> DataFrame:
    """Left join on the statistic's keys; a null key never matches."""
    return df.join(stat, list(SPEC_BY_NAME[name].keys), "left")


def enrich_single(df: DataFrame, name: str, value: str = "ArrDelay") -> DataFrame:
    """One statistic computed from ``df``, written, and joined back: the
    planner sees its real size, so a small statistic is broadcast and the
    trips are not shuffled on a key of a few values."""
    return enrich_one(df, materialize(single_stat(df, SPEC_BY_NAME[name], value)), name)


def fill_averages(df: DataFrame) -> DataFrame:
    """Null averages (join misses) -> 0.0; the two counts stay null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in K.AVERAGE_COLUMNS})


def enrich_all(df: DataFrame, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """All six statistics joined back, averages filled, rush-hour flag.

    Without given statistics ``df`` is written first: they and the joins read
    it, so that its own joins run once, and the code of one stage stays small
    enough to be compiled.  Give it no more columns than are needed."""
    if stats is None:
        df = materialize(df)
        stats = compute_stats(df)
    out = df
    for name in ENRICH_ORDER:
        out = enrich_one(out, stats[name], name)
    return fill_averages(out).withColumn("IsRushHour", X.is_rush_hour("DepHour"))
