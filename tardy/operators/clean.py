"""Cleaning policies: status filter, safe casts, three drop-null policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as X


def status_filter(df: DataFrame) -> DataFrame:
    """Operated flights only; a null status drops the row.  Pushed to the scan."""
    return df.filter((F.col("Cancelled") == 0) & (F.col("Diverted") == 0))


def clean_flights(df: DataFrame) -> DataFrame:
    """Status filter, drop the status columns, delays to double (bad -> null)."""
    return (status_filter(df)
            .drop("Cancelled", "Diverted")
            .withColumns({c: F.col(c).try_cast("double") for c in ("ArrDelay", "DepDelay")}))


def project_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def cast_numeric(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Cast the listed columns that exist to double, in one projection."""
    names = K.EDA_CAST_COLUMNS if names is None else names
    present = [c for c in names if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def clean_eda(df: DataFrame) -> DataFrame:
    """Exploration table: status filter, DepHour, numeric casts, non-null delays."""
    out = (status_filter(df).drop("Cancelled", "Diverted")
           .withColumn("DepHour", X.hour_of("DepTime")))
    return cast_numeric(out).dropna(subset=["ArrDelay", "DepDelay"])


def clean_regression(df: DataFrame) -> DataFrame:
    """Regression table: derived columns, nulls dropped before statistics."""
    out = X.with_calendar_and_time(clean_flights(df))
    out = out.dropna(subset=["ArrDelay", "DepDelay", "UniqueCarrier", "Origin", "Dest"])
    return out.withColumns(X.band_features())


def clean_classification_base(df: DataFrame) -> DataFrame:
    """Classification table before statistics: only the status filter and
    derived columns; null delays stay (statistics count them)."""
    return X.with_calendar_and_time(clean_flights(df)).withColumns(X.band_features())


def model_input(df: DataFrame, numeric: list[str], label_cols: list[str]) -> DataFrame:
    """Model columns in a fixed order: categoricals, numerics, labels."""
    cols = list(dict.fromkeys(K.CATEGORICAL_FEATURES + numeric + label_cols))
    return df.select(cols)
