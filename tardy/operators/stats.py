"""Group statistics of the arrival delay and the route distance map.

The six statistics are computed in ONE scan with grouping sets (an Expand
before partial aggregation, then a single small shuffle), instead of six
scans of the trip table.  Averages and counts are algebraic, so map-side
partial aggregation keeps a hot key (one carrier with a third of all rows)
from reaching one reducer as raw rows.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import (MAX_BROADCAST_BYTES, delete_path, list_path, materialize_parts, move_path, path_bytes,
                            path_exists, within_budget)

STAT_KEYS = ["UniqueCarrier", "DepHour", "Route", "Origin", "Dest"]


@dataclass(frozen=True)
class StatSpec:
    name: str
    keys: tuple[str, ...]
    avg_col: str
    count_col: str | None = None


STAT_SPECS = [
    StatSpec("carrier_stats", ("UniqueCarrier",), "AvgCarrierDelay", "CarrierFlightCount"),
    StatSpec("hour_stats", ("DepHour",), "AvgHourDelay"),
    StatSpec("route_stats", ("Route",), "AvgRouteDelay", "RouteFlightCount"),
    StatSpec("origin_stats", ("Origin",), "AvgOriginDelay"),
    StatSpec("dest_stats", ("Dest",), "AvgDestDelay"),
    StatSpec("carrier_hour_stats", ("UniqueCarrier", "DepHour"), "AvgCarrierHourDelay"),
]
SPEC_BY_NAME = {s.name: s for s in STAT_SPECS}


def _gid(keys: tuple[str, ...]) -> int:
    """grouping_id() of a set: bit i (from the left) is 1 when key i is absent."""
    n = len(STAT_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(STAT_KEYS) if k not in keys)


def single_stat(df: DataFrame, spec: StatSpec, value: str = "ArrDelay") -> DataFrame:
    aggs = [F.avg(value).alias(spec.avg_col)]
    if spec.count_col:
        aggs.append(F.count(F.lit(1)).alias(spec.count_col))
    return df.groupBy(*spec.keys).agg(*aggs)


def all_stats_long(df: DataFrame, value: str = "ArrDelay") -> DataFrame:
    """All six statistics from one scan; ``level`` names the statistic.

    grouping_id() separates levels, so a null DepHour group is never
    confused with "not grouped by DepHour".
    """
    gid_to_level = F.lit(None).cast("string")
    for s in STAT_SPECS:
        gid_to_level = F.when(F.col("gid") == _gid(s.keys), s.name).otherwise(gid_to_level)
    sets = [list(s.keys) for s in STAT_SPECS]
    return (df.groupingSets(sets, *STAT_KEYS)
              .agg(F.avg(value).alias("AvgDelay"),
                   F.count(F.lit(1)).alias("FlightCount"),
                   F.grouping_id().alias("gid"))
              .withColumn("level", gid_to_level)
              .drop("gid"))


def split_stats(long_df: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for s in STAT_SPECS:
        cols = [F.col(k) for k in s.keys] + [F.col("AvgDelay").alias(s.avg_col)]
        if s.count_col:
            cols.append(F.col("FlightCount").alias(s.count_col))
        out[s.name] = long_df.filter(F.col("level") == s.name).select(*cols)
    return out


class Statistics(dict):
    """Statistic name -> table; ``large`` names those that are not broadcast."""

    def __init__(self, tables: dict[str, DataFrame], sizes: dict[str, int], budget: int):
        small = within_budget(sizes, budget)
        super().__init__({k: F.broadcast(t) if k in small else t for k, t in tables.items()})
        self.large = set(tables) - small


def compute_stats(df: DataFrame, value: str = "ArrDelay",
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> Statistics:
    """The six statistics, written once; those that fit the budget of bytes
    together, the smallest first, are marked for broadcast."""
    written, sizes = materialize_parts(all_stats_long(df, value), "level")
    return Statistics(split_stats(written), {s.name: sizes.get(s.name, 0) for s in STAT_SPECS}, max_broadcast_bytes)


def route_distances(raw: DataFrame) -> DataFrame:
    """Route -> one distance, from the uncleaned table.  Several distances on
    one route: the smallest wins (deterministic)."""
    return (raw.select("Origin", "Dest", "Distance").dropna()
               .groupBy("Origin", "Dest")
               .agg(F.min(F.col("Distance").cast("int")).alias("Distance")))


def distinct_routes(raw: DataFrame) -> DataFrame:
    return raw.select("Origin", "Dest", "Distance").dropna().distinct()


STATS_SCHEMAS = {
    "carrier_stats": "UniqueCarrier string, AvgCarrierDelay double, CarrierFlightCount bigint",
    "hour_stats": "DepHour int, AvgHourDelay double",
    "route_stats": "Route string, AvgRouteDelay double, RouteFlightCount bigint",
    "origin_stats": "Origin string, AvgOriginDelay double",
    "dest_stats": "Dest string, AvgDestDelay double",
    "carrier_hour_stats": "UniqueCarrier string, DepHour int, AvgCarrierHourDelay double",
    "route_distances": "Origin string, Dest string, Distance int",
}


def save_stats(stats: dict[str, DataFrame], path: str, keep: int = 3) -> str:
    """One parquet table per statistic (replaces a pickled dictionary), all of
    them as one version: written aside, then put in place by one rename, so
    that a reader finds all old or all new tables.  The ``keep`` newest
    versions stay for readers that opened one before.  Returns the version."""
    spark = next(iter(stats.values())).sparkSession
    root = path.rstrip("/")
    version = f"version-{time.time_ns() // 1_000_000:014d}-{uuid.uuid4().hex[:8]}"
    for name, t in stats.items():
        t.write.parquet(f"{root}/_staging/{version}/{name}")
    move_path(spark, f"{root}/_staging/{version}", f"{root}/{version}")
    for old in stats_versions(spark, root)[:-keep]:
        delete_path(spark, f"{root}/{old}")
    return version


def stats_versions(spark: SparkSession, path: str) -> list[str]:
    """The saved versions, the newest last."""
    return [n for n in list_path(spark, path) if n.startswith("version-")]


def load_stats(spark: SparkSession, path: str, max_broadcast_bytes: int = 0,
               version: str | None = None) -> Statistics:
    """All saved statistics of one version (the newest); a missing table reads
    as empty, any other fault is raised.  With a budget of bytes, the smallest
    tables that fit it together are marked for broadcast."""
    versions = [version] if version else stats_versions(spark, path)
    root = f"{path.rstrip('/')}/{versions[-1]}" if versions else path.rstrip("/")
    tables, sizes = {}, {}
    for name, ddl in STATS_SCHEMAS.items():
        at = f"{root}/{name}"
        here = path_exists(spark, at)
        tables[name] = spark.read.schema(ddl).parquet(at) if here else spark.createDataFrame([], ddl)
        sizes[name] = path_bytes(spark, at) if here else 0
    return Statistics(tables, sizes, max_broadcast_bytes)
