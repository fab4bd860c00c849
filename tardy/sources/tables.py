"""Readers for the raw test tables (parquet; Catalyst prunes columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the split size settings decide how it is read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
