"""Exploratory aggregates: group averages, top-k, pivot, row counts,
correlation, trend line, value range, threshold share, summary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import features as X


def avg_delay_by(df: DataFrame, *keys: str, value: str = "ArrDelay") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("AvgDelay"))


def delay_by_carrier(df: DataFrame) -> DataFrame:
    return avg_delay_by(df, "UniqueCarrier").orderBy(F.desc("AvgDelay"), "UniqueCarrier")


def delay_by_hour(df: DataFrame) -> DataFrame:
    return avg_delay_by(df, "DepHour").orderBy("DepHour")


def delay_by_day(df: DataFrame) -> DataFrame:
    return avg_delay_by(df, "DayOfWeek").orderBy("DayOfWeek")


def delay_by_day_named(df: DataFrame) -> DataFrame:
    return delay_by_day(df).withColumn("DayName", X.day_name(F.col("DayOfWeek").cast("int")))


def delay_day_hour(df: DataFrame) -> DataFrame:
    return avg_delay_by(df, "DayOfWeek", "DepHour").orderBy("DayOfWeek", "DepHour")


def pivot_day_hour(df: DataFrame, hours: range = range(0, 25)) -> DataFrame:
    """Rows DayOfWeek, columns h0..h24 = average delay, h_null for trips
    without an hour and h_other for any further value, so no row is lost.
    The value list is given, so no extra job discovers it and the schema is
    fixed."""
    hour, delay = F.col("DepHour"), F.col("ArrDelay")
    cells = [F.avg(F.when(hour == h, delay)).alias(f"h{h}") for h in hours]
    return df.groupBy("DayOfWeek").agg(
        *cells, F.avg(F.when(hour.isNull(), delay)).alias("h_null"),
        F.avg(F.when(~hour.isin(*hours), delay)).alias("h_other"))


def top_routes(df: DataFrame, min_flights: int = 50, k: int = 10) -> DataFrame:
    """Top-k routes by average delay among routes with more than
    ``min_flights`` flights; Route breaks ties."""
    routes = (df.withColumn("Route", X.route_key_strict("Origin", "Dest"))
                .groupBy("Route")
                .agg(F.avg("ArrDelay").alias("AvgDelay"), F.count(F.lit(1)).alias("FlightCount"))
                .filter(F.col("FlightCount") > min_flights))
    return routes.orderBy(F.desc("AvgDelay"), F.asc_nulls_first("Route")).limit(k)


def top_taxi_out(df: DataFrame, min_flights: int = 1000, k: int = 20) -> DataFrame:
    origins = (df.groupBy("Origin")
                 .agg(F.avg("TaxiOut").alias("AvgTaxiOut"), F.count(F.lit(1)).alias("FlightCount"))
                 .filter(F.col("FlightCount") > min_flights))
    return origins.orderBy(F.desc("AvgTaxiOut"), F.asc_nulls_first("Origin")).limit(k)


def speed(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("AirTime") > 0)
              .withColumn("Speed_MPH", X.speed_mph("Distance", "AirTime"))
              .select("Distance", "Speed_MPH", "UniqueCarrier"))


def speed_trend(df: DataFrame) -> DataFrame:
    """Least-squares line Speed_MPH ~ Distance (one pass, algebraic aggs)."""
    s = speed(df)
    y, x = F.col("Speed_MPH"), F.col("Distance")
    return s.agg(F.regr_slope(y, x).alias("slope"),
                 F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2"),
                 F.regr_count(y, x).alias("n"))


def value_range(df: DataFrame, cols=("ArrDelay", "DepDelay")) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def late_share(df: DataFrame, threshold: float = K.LATE_SHARE_THRESHOLD,
               value: str = "ArrDelay") -> DataFrame:
    late = F.when(F.col(value) > threshold, 1.0).otherwise(0.0)
    return df.agg(F.avg(late).alias("late_share"), F.count(F.lit(1)).alias("n"))


def range_filter(df: DataFrame, lo: float = -60, hi: float = 180,
                 value: str = "ArrDelay") -> DataFrame:
    return df.filter(F.col(value).between(lo, hi))


def numeric_columns(df: DataFrame, excluded=None) -> list[str]:
    """Integer and double columns minus the exclusion list (by schema)."""
    excluded = K.CORRELATION_EXCLUDED if excluded is None else excluded
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.DoubleType)) and f.name not in excluded]


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, pairwise-complete; the full
    matrix in long form (col_a, col_b, corr), null without common rows.

    One aggregate of cross products: a row is the vector of its values, their
    squares and its mask of present values, and the sum of the outer products
    holds the count, sums and products of every pair over the rows that have
    both.  The buffer is of the columns squared, the plan is linear in them.
    Values are taken from those of some row on, so that nothing cancels.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    cols = numeric_columns(df) if cols is None else cols
    p, spark = len(cols), df.sparkSession
    data = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    some = data.limit(1).collect()
    shift = [(some[0][i] or 0.0) if some else 0.0 for i in range(p)]
    x = [F.coalesce(F.col(f"x{i}") - F.lit(shift[i]), F.lit(0.0)) for i in range(p)]
    here = [F.col(f"x{i}").isNotNull().cast("double") for i in range(p)]
    vectors = data.select(array_to_vector(F.array(*x, *[v * v for v in x], *here)).alias("v"))
    # no row at all: the sum of outer products is not defined
    rows = MLUtils.convertVectorColumnsFromML(vectors, "v")
    g = RowMatrix(rows, 0, 3 * p).computeGramianMatrix().toArray() if some else np.zeros((3 * p, 3 * p))
    z, sq, m = slice(0, p), slice(p, 2 * p), slice(2 * p, 3 * p)
    n, sx, sxx = g[m, m], g[z, m], g[sq, m]
    spread = np.maximum(n * sxx - sx * sx, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * g[z, z] - sx * sx.T) / np.sqrt(spread * spread.T)
    found = [(a, b, float(r[i, j]) if n[i, j] else None) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(found, "col_a string, col_b string, corr double")


def row_counts(raw: DataFrame) -> DataFrame:
    """Row counts of every cleaning policy in ONE scan of the raw table."""
    ok = (F.col("Cancelled") == 0) & (F.col("Diverted") == 0)
    arr = F.col("ArrDelay").try_cast("double").isNotNull()
    dep = F.col("DepDelay").try_cast("double").isNotNull()
    keys = (F.col("UniqueCarrier").isNotNull() & F.col("Origin").isNotNull()
            & F.col("Dest").isNotNull())
    return raw.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(ok).alias("n_operated"),
        F.count_if(ok & arr & dep).alias("n_eda"),
        F.count_if(ok & arr & dep & keys).alias("n_regression"),
        F.count_if(ok & arr & keys).alias("n_classification"),
    )


def summary_stats(df: DataFrame, cols=None) -> DataFrame:
    """count, mean, stddev (sample), min, exact 25/50/75 % (discrete), max
    per column, long form.  The columns are stacked into (column, value)
    rows so one pass serves all of them; the quartiles come from
    range-partitioned running counts, so no task holds a whole column."""
    from ..plans.quantiles import exact_percentiles
    cols = [c for c in (K.SUMMARY_COLUMNS if cols is None else cols) if c in df.columns]
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (column, x)").filter(F.col("x").isNotNull())
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("stddev"), F.min("x").alias("min"), F.max("x").alias("max"))
    quart = exact_percentiles(long, "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"],
                              discrete=True)
    out = moments.join(quart.drop("n"), "column")
    return out.select("column", "count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def label_balance(df: DataFrame, labels=("DelayOver30", "DelayOver60")) -> DataFrame:
    """Class counts (0 and 1) of each label, in ONE aggregate."""
    aggs, rows = [], []
    for i, lab in enumerate(labels):
        aggs += [F.count_if(F.col(lab) == 0).alias(f"z{i}"), F.count_if(F.col(lab) == 1).alias(f"o{i}")]
        rows += [f"'{lab}', 0, z{i}", f"'{lab}', 1, o{i}"]
    return df.agg(*aggs).selectExpr(
        f"stack({len(rows)}, {', '.join(rows)}) as (label, value, count)")


def union_tagged(df: DataFrame) -> DataFrame:
    """Average delay by origin and by destination stacked with a tag.  Both
    tables come from ONE scan (grouping sets), then a union-shaped select."""
    g = (df.groupingSets([["Origin"], ["Dest"]], "Origin", "Dest")
           .agg(F.avg("ArrDelay").alias("AvgDelay"), F.count(F.lit(1)).alias("FlightCount"),
                F.grouping_id().alias("gid")))
    return g.select(
        F.when(F.col("gid") == 1, "origin").otherwise("dest").alias("tag"),
        F.when(F.col("gid") == 1, F.col("Origin")).otherwise(F.col("Dest")).alias("airport"),
        "AvgDelay", "FlightCount")
