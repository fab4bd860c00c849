"""Distribution shapes: equal-width histograms, density, kernel density on a
grid, box-plot statistics.

The data range comes from scalar subqueries (``DataFrame.scalar``): Spark
runs the min/max aggregate once and plugs the values into the bin
expression; no data passes through the driver and no cross join is needed.
Bins, densities and box statistics are partial aggregates (map-side
combine), so a hot group never reaches one reducer as raw rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import exact_percentiles
from ..plans.sizing import bounded_broadcast, materialize


def _bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of x over [lo, hi]; the last bin is right-closed."""
    width = (hi - lo) / bins
    raw = F.floor(F.try_divide(x - lo, width))
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def _one_row_scalar(row: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery.  The row is
    materialised first (one job, a tiny table in the shared checkpoint
    folder), so each reference reads that table instead of re-running the
    aggregate over the data."""
    return materialize(row.select(F.struct(*row.columns).alias("s"))).scalar()


def _range_stats(vals: DataFrame) -> Column:
    """min, max, count and sample std of ``x`` (one pass, one row)."""
    return _one_row_scalar(vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                    F.count(F.lit(1)).alias("n"),
                                    F.stddev_samp("x").alias("sd")))


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())


def histograms(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """(variable, bin, bin_lo, bin_hi, count) for all bins of all columns,
    empty ones included: one pass for the ranges, one for the counts.  A
    column without values has no bins."""
    spread = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns)
                      for n, f in (("lo", F.min), ("hi", F.max))])
    st = _one_row_scalar(spread)
    stack = ", ".join(f"{i}, cast(`{c}` as double)" for i, c in enumerate(columns))
    vals = (df.selectExpr(f"stack({len(columns)}, {stack}) as (variable, x)")
              .filter(F.col("x").isNotNull()))

    def bound(name: str) -> Column:
        out = F.lit(None).cast("double")
        for i in range(len(columns)):
            out = F.when(F.col("variable") == i, st.getField(f"{name}{i}")).otherwise(out)
        return out

    counts = (vals.groupBy("variable", _bin_index(F.col("x"), bound("lo"), bound("hi"), bins).alias("bin"))
                  .agg(F.count(F.lit(1)).alias("count")))
    all_bins = df.sparkSession.range(bins * len(columns)).select(
        F.expr(f"cast(id div {bins} as int)").alias("variable"), F.expr(f"cast(id % {bins} as int)").alias("bin"))
    lo, hi = bound("lo"), bound("hi")
    width = (hi - lo) / bins
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("variable") + 1)
    # at most one row per column and bin on the build side
    return (all_bins.join(F.broadcast(counts), ["variable", "bin"], "left").filter(lo.isNotNull())
                    .select(names.alias("variable"), "bin",
                            (lo + F.col("bin") * width).alias("bin_lo"),
                            (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    return histograms(df, [column], bins)


def density_histogram(df: DataFrame, column: str = "ArrDelay", bins: int = 100,
                      lo_keep: float = -60, hi_keep: float = 180) -> DataFrame:
    """Histogram of the values inside [lo_keep, hi_keep], as a density:
    count / (n * width), so the bars integrate to one."""
    kept = df.filter(F.col(column).between(lo_keep, hi_keep))
    h = histogram(kept, column, bins)
    n = F.sum("count").over(Window.partitionBy())  # bins rows only
    return h.withColumn("density", F.try_divide(F.col("count"),
                                                n * (F.col("bin_hi") - F.col("bin_lo"))))


#: bins per bandwidth, order of the expansion inside a bin, and how many
#: bandwidths a kernel reaches
KDE_BINS, KDE_ORDER, KDE_REACH = 32, 5, 9


def kde_curve(df: DataFrame, column: str = "ArrDelay", points: int = 100) -> DataFrame:
    """Gaussian kernel density at ``points`` grid points over [min, max];
    bandwidth by Scott's rule (sample std * n^(-1/5)).

    Values are reduced to bins of 1 / KDE_BINS bandwidth, each with the
    moments of its values about its middle.  The kernel of a value at
    distance s from the middle (in bandwidths) is that of the middle times
    the sum of He_k(u) s^k / k!, so a bin and a grid point cost one
    exponential.  Cut after order 5 the error is below 4e-13 of a kernel's
    peak; kernels end at KDE_REACH bandwidths (3e-18).  The number of bins
    follows the range in bandwidths, not the number of distinct values.
    """
    vals = _values(df, column)
    st = _range_stats(vals)
    lo, hi, n = st.getField("lo"), st.getField("hi"), st.getField("n")
    bw = st.getField("sd") * F.pow(n.cast("double"), F.lit(-0.2))
    step = (hi - lo) / (points - 1)
    width = bw / KDE_BINS
    place = F.try_divide(F.col("x") - lo, width)
    at = F.coalesce(F.floor(place), F.lit(0))
    offset = (F.coalesce(place, F.lit(0.0)) - at - 0.5) / KDE_BINS
    bins = (vals.select(at.alias("bin"), offset.alias("s")).groupBy("bin")
            .agg(*[F.sum(F.pow("s", F.lit(k))).alias(f"m{k}") for k in range(KDE_ORDER + 1)]))
    # the grid points within reach of a bin
    middle = (F.col("bin") + 0.5) * width
    first = F.greatest(F.lit(0), F.ceil(F.try_divide(middle - KDE_REACH * bw, step)))
    last = F.least(F.lit(points - 1), F.floor(F.try_divide(middle + KDE_REACH * bw, step)))
    met = bins.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    u = (F.col("point") * step - middle) / bw
    hermite = [F.lit(1.0), u]
    for k in range(1, KDE_ORDER):
        hermite.append(u * hermite[k] - k * hermite[k - 1])
    series = sum((h * F.col(f"m{k}") / math.factorial(k) for k, h in enumerate(hermite)), F.lit(0.0))
    sums = met.groupBy("point").agg(F.sum(F.exp(-0.5 * u * u) * series).alias("s"))
    norm = n * bw * F.lit(math.sqrt(2 * math.pi))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).filter(n > 0)
    # a row for each grid point at most
    return grid.join(F.broadcast(sums), "point", "left").select(
        "point", (lo + F.col("point") * step).alias("x"),
        F.try_divide(F.coalesce("s", F.lit(0.0)), norm).alias("density"))


def box_stats(df: DataFrame, column: str = "ArrDelay", group: str | None = None,
              lo_keep: float | None = None, hi_keep: float | None = None) -> DataFrame:
    """Q1, median, Q3 (linear interpolation), whiskers at the furthest value
    inside 1.5 IQR of the box, and the outlier count; per group if given.

    First the exact percentiles per group (``plans/quantiles.py``: two scans,
    no task holds a whole group).  Then join the small per-group fences back (broadcast only below the measured row bound) and
    take conditional min/max/count, again partial aggregates.  Without a
    group the same plan runs on one constant key.
    """
    data = df
    if lo_keep is not None:
        data = data.filter(F.col(column).between(lo_keep, hi_keep))
    keys = [group] if group else []
    data = data.select(*keys, F.col(column).cast("double").alias("x")) \
               .filter(F.col("x").isNotNull())
    quartiles = exact_percentiles(data, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    cols = ["q1", "median", "q3", "iqr", "n", "whisker_lo", "whisker_hi", "outliers"]

    def whiskers(lo: Column, hi: Column):
        inside = F.col("x").between(lo, hi)
        return [F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
                F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
                F.count_if(~inside).alias("outliers")]

    if not group:
        # one struct-valued scalar subquery for the box; whiskers in one pass
        box = _one_row_scalar(quartiles.select("q1", "median", "q3", "n"))
        q1, q3 = box.getField("q1"), box.getField("q3")
        iqr = q3 - q1
        w = data.agg(*whiskers(q1 - 1.5 * iqr, q3 + 1.5 * iqr))
        return w.select(q1.alias("q1"), box.getField("median").alias("median"), q3.alias("q3"),
                        iqr.alias("iqr"), box.getField("n").alias("n"),
                        "whisker_lo", "whisker_hi", "outliers")
    q = quartiles.select(group, "q1", "median", "q3", "n")
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("fence_lo", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("fence_hi", F.col("q3") + 1.5 * F.col("iqr"))
    # one fence row per group: broadcast only below the measured row bound
    fences = bounded_broadcast(q)
    w = (data.join(fences.select(group, "fence_lo", "fence_hi"), group)
             .groupBy(group).agg(*whiskers(F.col("fence_lo"), F.col("fence_hi"))))
    return fences.join(w, group).select(group, *cols)
