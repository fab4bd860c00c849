"""Exclusive prefix sums in key order without a single-task window.

Rows are range-partitioned on the order key (Spark samples the bounds) and
written together with the number of their range: that table is the one fixed
assignment of rows to ranges, and every later step reads it.  Per-range
totals get an exclusive running sum; inside a range a window partitioned by
the range number adds the local running sum.  No task ever holds more than
one key range, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizing import materialize

# rows of one key range: a few MB of narrow rows, so that a few hundred
# distinct keys are one task and a billion are some thousand
ROWS_PER_RANGE = 250_000


def fixed_ranges(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its key range in ``_range``, written once.
    The number of ranges follows from the number of rows."""
    if ranges is None:
        df = materialize(df)  # counted and ranged without computing it twice
        ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    return materialize(df.repartitionByRange(ranges, *keys)
                         .withColumn("_range", F.spark_partition_id()))


def exclusive_prefix_sums(df: DataFrame, order_col: str, value_cols: list[str],
                          ranges: int | None = None,
                          partition_cols: list[str] | None = None) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over rows with a smaller key (within
    the same ``partition_cols`` group, if given).

    ``df`` must have unique (``partition_cols``, ``order_col``) values
    (pre-aggregate first).
    """
    groups = list(partition_cols or [])
    ranged = fixed_ranges(df, [*groups, order_col], ranges)
    # one row per (key range, group present in it): at most ranges + groups
    totals = ranged.groupBy("_range", *groups).agg(
        *[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    over_ranges = Window.partitionBy(*groups).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *groups, *[
        F.coalesce(F.sum(f"_t_{v}").over(over_ranges), F.lit(0)).alias(f"_o_{v}")
        for v in value_cols])
    inside = Window.partitionBy("_range", *groups).orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l_{v}")
                                 for v in value_cols])
    # the offsets are a plain join side: Spark sizes them from the written
    # table, AQE from the aggregate; a null group key must meet itself
    keys = ["_range", *groups]
    right = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{v}" for v in value_cols])
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = same if cond is None else cond & same
    return local.join(right, cond).select(
        *df.columns, *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{v}_before") for v in value_cols])
