"""Category indices as a table, for columns of any number of values.

Values are ranked by (column, count descending, value) over key ranges
(``plans/prefix.py``): no task holds a column, and no array of labels is
built on the driver.  The index is joined back like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import exclusive_prefix_sums
from ..plans.sizing import bounded_broadcast, materialize


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label, count) of every value, from one grouping-sets scan."""
    counts = (df.groupingSets([[c] for c in columns], *columns)
              .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid")))
    column, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("gid") == (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        column, label = F.when(here, c).otherwise(column), F.when(here, F.col(c)).otherwise(label)
    return counts.select(column.alias("column"), label.alias("label"), "count")


def category_index(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """(column, label, count, index): frequent values first, ties by label."""
    counts = category_counts(df, columns).withColumns({
        "order": F.struct((-F.col("count")).alias("n"), "label"), "one": F.lit(1)})
    return exclusive_prefix_sums(counts, "order", ["one"], ranges, ["column"]).select(
        "column", "label", "count", F.col("one_before").cast("double").alias("index"))


def with_indices(df: DataFrame, index: DataFrame, columns: list[str], suffix: str = "Index") -> DataFrame:
    """``df`` with the index of each column's value; a value that the index
    does not know (null too) gets the number of known values, as the model
    stages' "keep" does.  Each column's part of the index is broadcast only if
    its written bytes fit, else joined by shuffle."""
    sizes = {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:
        part = materialize(index.filter((F.col("column") == c) & F.col("label").isNotNull())
                           .select(F.col("label").alias(c), F.col("index").alias(f"{c}{suffix}")))
        df = df.join(bounded_broadcast(part, already_materialized=True), c, "left").withColumn(
            f"{c}{suffix}", F.coalesce(f"{c}{suffix}", F.lit(float(sizes.get(c, 0)))))
    return df
