"""Model metrics as distributed aggregates (SQL twins of the evaluators).

RMSE, MAE, R^2 and accuracy are single-pass algebraic aggregates.  The
area under ROC is the exact Mann-Whitney statistic with tie averaging:
scores are reduced to (distinct score, positives, negatives) by a partial
aggregate and the negatives ranked below each score come from a
range-partitioned prefix sum (no global single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import exclusive_prefix_sums


def regression_metrics(df: DataFrame, label: str = "ArrDelay",
                       prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - p
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"),
                  F.sum(F.abs(err)).alias("sae"), F.avg(y).alias("ybar"),
                  F.var_pop(y).alias("yvar"))
    return sums.select(
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        (1 - F.col("sse") / (F.col("yvar") * F.col("n"))).alias("r2"),
        "n")


def accuracy(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    hit = F.when(F.col(label).cast("double") == F.col(prediction).cast("double"), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _per_score(df: DataFrame, score: str, label: str, hit=None) -> DataFrame:
    """One row per distinct score with its class counts (and hits)."""
    s = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"),
                  (F.lit(0) if hit is None else hit.cast("int")).alias("h"))
    return s.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
                              F.sum("h").alias("hits"), F.count(F.lit(1)).alias("rows"))


def _auc(ranked: DataFrame) -> DataFrame:
    part = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    tot = ranked.agg(F.sum(part).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                     F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    return tot.select(F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("auc"),
                      F.col("P").alias("positives"), F.col("N").alias("negatives"),
                      F.try_divide(F.col("hits"), F.col("rows")).alias("accuracy"))


def auc_rank_sum(df: DataFrame, score: str, label: str) -> DataFrame:
    return _auc(exclusive_prefix_sums(_per_score(df, score, label), "s", ["neg"])).drop("accuracy")


def auc_and_accuracy(df: DataFrame, score: str, label: str, prediction: str = "prediction") -> DataFrame:
    """Both from one aggregate over the predictions."""
    hit = F.col(label).cast("double") == F.col(prediction).cast("double")
    return _auc(exclusive_prefix_sums(_per_score(df, score, label, hit), "s", ["neg"]))
