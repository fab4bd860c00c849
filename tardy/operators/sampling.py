"""Sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialize


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(False, fraction, seed)


#: bits of the sample key, and repeats of a row that one task numbers at once
KEY_BITS, REPEATS = 60, 10_000


def _counted(df: DataFrame) -> DataFrame:
    """The distinct rows with their number ``_n``."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))


def keyed_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Every row with ``_key``, a hash (KEY_BITS bits of the MD5) of the seed,
    its values and its number among equal rows.

    The key depends on the rows alone, not on their order or partitions.
    Equal rows are counted first (a partial aggregate) and numbered in chunks,
    so a row that makes up a third of the table is spread over many tasks.
    """
    return _keyed(_counted(df), df.columns, seed)


def _keyed(counts: DataFrame, cols: list[str], seed: int) -> DataFrame:
    chunk = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / REPEATS))))
    low = F.col("_chunk") * REPEATS
    high = F.least(low + REPEATS, F.col("_n")) - 1
    each = (chunk.repartition(*[F.col(c) for c in cols], "_chunk")
            .withColumn("_copy", F.explode(F.sequence(low, high))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols],
                       F.col("_copy").cast("string"))
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    return each.select(*cols, "_copy", key.alias("_key"))


def keyed_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with probability ``fraction``, the same rows in every run."""
    return keyed_rows(df, seed).filter(F.col("_key") < int(fraction * (1 << KEY_BITS))).select(*df.columns)


def capped_sample(df: DataFrame, cap: int = 5000, seed: int = 42) -> DataFrame:
    """Exactly min(cap, rows) rows: those with the smallest keys.

    Keys below a bound that a little more than ``cap`` rows are expected to
    meet are written (the bound is doubled until enough do), so that only
    about ``cap`` rows are ever sorted.  ``df`` itself is computed once: its
    distinct rows are written with their numbers, for the size and the keys.
    """
    counts = materialize(_counted(df))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    if n <= cap:
        return df
    share = (cap + 6 * cap ** 0.5 + 10) / n
    keyed = _keyed(counts, df.columns, seed)
    while True:
        low = materialize(keyed.filter(F.col("_key") < int(min(1.0, share) * (1 << KEY_BITS))))
        if share >= 1 or low.count() >= cap:
            return low.orderBy("_key", *df.columns, "_copy").limit(cap).select(*df.columns)
        share *= 2


def stable_split_label(cols: list[str], train_tenths: int = 8) -> Column:
    """Deterministic train/test label from row values: the same row lands
    on the same side in every run and on every engine."""
    total = None
    for i, c in enumerate(cols):
        term = F.coalesce(F.col(c).cast("bigint"), F.lit(0)) * (2 * i + 1)
        total = term if total is None else total + term
    bucket = ((total % 10) + 10) % 10
    return F.when(bucket < train_tenths, "train").otherwise("test")
