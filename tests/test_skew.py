"""A key holding a third of all rows: statistics, enrichment, box
statistics and AUC stay exact (compared with plain pandas)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tardy.operators import distribution as D
from tardy.operators import enrich as J
from tardy.operators import metrics as MT
from tardy.operators import stats as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 30000
    carrier = np.where(np.arange(n) % 3 == 0, "HOT", np.char.add("C", (rng.integers(0, 50, n)).astype(str)))
    pdf = pd.DataFrame({
        "UniqueCarrier": carrier,
        "DepHour": rng.integers(0, 25, n).astype("int32"),
        "Origin": np.char.add("O", rng.integers(0, 30, n).astype(str)),
        "Dest": np.char.add("D", rng.integers(0, 30, n).astype(str)),
        "ArrDelay": rng.integers(-30, 200, n).astype("float64"),
    })
    pdf["Route"] = pdf.Origin + "-" + pdf.Dest
    df = spark.createDataFrame(pdf).repartition(16)
    return pdf, df


def test_stats_and_enrich_with_hot_key(skewed):
    pdf, df = skewed
    st = S.compute_stats(df)
    got = {r.UniqueCarrier: (r.AvgCarrierDelay, r.CarrierFlightCount) for r in st["carrier_stats"].collect()}
    exp = pdf.groupby("UniqueCarrier").ArrDelay.agg(["mean", "count"])
    assert got["HOT"][1] == exp.loc["HOT", "count"] == 10000
    for k, (m, c) in got.items():
        assert abs(m - exp.loc[k, "mean"]) < 1e-9 and c == exp.loc[k, "count"]
    out = J.enrich_all(df, st)
    assert out.count() == len(pdf)
    hot = out.filter(F.col("UniqueCarrier") == "HOT").select("AvgCarrierDelay").distinct().collect()
    assert len(hot) == 1 and abs(hot[0][0] - exp.loc["HOT", "mean"]) < 1e-9


def test_box_stats_with_hot_group(skewed):
    pdf, df = skewed
    got = {r.UniqueCarrier: r for r in D.box_stats(df, "ArrDelay", group="UniqueCarrier").collect()}
    x = pdf[pdf.UniqueCarrier == "HOT"].ArrDelay
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    r = got["HOT"]
    assert (r.q1, r.median, r.q3, r.n) == (q1, med, q3, len(x))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = x[(x >= lo) & (x <= hi)]
    assert r.whisker_lo == inside.min() and r.whisker_hi == inside.max()
    assert r.outliers == len(x) - len(inside)


def test_auc_with_a_hot_score(spark):
    rng = np.random.default_rng(3)
    n = 20000
    score = np.where(np.arange(n) % 3 == 0, 0.5, rng.random(n).round(3))
    y = (rng.random(n) < score).astype(int)
    got = MT.auc_rank_sum(spark.createDataFrame(pd.DataFrame({"s": score, "y": y})), "s", "y").first().auc
    ranks = pd.Series(score).rank(method="average")
    P, N = y.sum(), n - y.sum()
    exp = (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    assert abs(got - exp) < 1e-12


def test_exact_percentiles_match_builtins_with_hot_group(spark):
    from tardy.plans.quantiles import exact_percentiles
    rng = np.random.default_rng(11)
    n = 20000
    g = np.where(np.arange(n) % 3 == 0, "HOT", np.char.add("G", rng.integers(0, 20, n).astype(str)))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": rng.normal(0, 10, n).round(4)}))
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    lin = {r.g: (r.a, r.b, r.c) for r in exact_percentiles(df, "x", probs, ["g"]).collect()}
    ref = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(
        *[F.percentile("x", p).alias(k) for k, p in probs.items()]).collect()}
    assert lin == ref
    disc = {r.g: (r.a, r.b, r.c) for r in exact_percentiles(df, "x", probs, ["g"], discrete=True).collect()}
    ref_d = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias(k)
          for k, p in probs.items()]).collect()}
    assert disc == ref_d


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_prefix_sums_are_exact_with_very_many_scores(spark, reuse):
    """Hundreds of thousands of distinct values over several ranges, the same
    in every run, whether or not Spark reuses exchanges."""
    from tardy.plans import prefix
    from tardy.plans.quantiles import exact_percentiles
    rng = np.random.default_rng(5)
    n = 300_000
    score = rng.random(n)
    y = (rng.random(n) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": score, "y": y})).repartition(8)
    rank = pd.Series(score).rank(method="average")
    P, N = y.sum(), n - y.sum()
    exact = (rank[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    old, prefix.ROWS_PER_RANGE = prefix.ROWS_PER_RANGE, 40_000
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        for _ in range(3 if reuse == "true" else 1):
            assert abs(MT.auc_rank_sum(df, "s", "y").first().auc - exact) < 1e-12
        got = exact_percentiles(df, "s", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
        assert np.allclose([got.a, got.b, got.c], np.percentile(score, [25, 50, 90]), atol=1e-12)
        groups = df.withColumn("g", F.when(F.col("y") == 1, "hot").otherwise(F.lit(None)))
        by = {r.g: r.b for r in exact_percentiles(groups, "s", {"b": 0.5}, ["g"]).collect()}
        assert abs(by["hot"] - np.percentile(score[y == 1], 50)) < 1e-12
    finally:
        prefix.ROWS_PER_RANGE = old
        spark.conf.set("spark.sql.exchange.reuse", "true")
