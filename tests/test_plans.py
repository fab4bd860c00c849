"""Plan properties: pushdown, pruning, size-checked broadcast, prefix sums."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy.plans.prefix import exclusive_prefix_sums
from tardy.plans.sizing import bounded_broadcast


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_and_pruning_reach_the_scan(spark):
    from tardy.catalog import REGISTRY
    df = REGISTRY["top_routes"](spark, SF_SMALL)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in text
    plan = _plan(df)
    # only the needed lineitem columns are read
    assert "l_extendedprice" not in plan and "l_comment" not in plan


def test_bounded_broadcast_respects_the_bound(spark):
    big = spark.range(0, 1000).withColumn("v", F.col("id") * 2)
    small = spark.range(0, 10).withColumn("w", F.col("id") + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(bounded_broadcast(small, max_bytes=1 << 20), "id")
        assert "BroadcastHashJoin" in _plan(hinted)
        not_hinted = big.join(bounded_broadcast(small, max_bytes=100), "id")
        assert "BroadcastHashJoin" not in _plan(not_hinted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prefix_sums_with_a_hot_key_range(spark):
    # many keys, one range of keys carries most of the weight
    df = spark.range(0, 500).select(F.col("id").cast("double").alias("k"),
                                    F.when(F.col("id") < 10, 1000).otherwise(1).alias("w"))
    out = {r.k: r.w_before for r in exclusive_prefix_sums(df, "k", ["w"], ranges=7).collect()}
    running, expect = 0, {}
    for k in range(500):
        expect[float(k)] = running
        running += 1000 if k < 10 else 1
    assert out == expect


def test_enrichment_does_not_shuffle_the_trips_on_a_few_values(spark):
    from tardy.catalog import REGISTRY
    # the threshold is far below the trips and above the small statistic
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16384")
    try:
        plan = _plan(REGISTRY["enrich_carrier"](spark, SF_SMALL))
        assert "hashpartitioning(UniqueCarrier" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_items_are_shuffled_by_order_only(spark):
    from tardy.sources.flights import flights_view
    for t in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(t, "-1")
    try:
        plan = flights_view(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for t in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(t)
    customers = next(row for row in plan.splitlines() if "Join" in row and "c_custkey" in row)
    orders = next(row for row in plan.splitlines() if "Join" in row and "l_orderkey" in row)
    # the join with the customers lies below the one with the line items
    assert customers.index("Join") > orders.index("Join")


def test_enrichment_reads_written_rows_not_the_view_twice(spark):
    from tardy.catalog import enriched_regression
    plan = enriched_regression(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("Join") == 6


def test_label_balance_computes_no_statistics(spark):
    from tardy.catalog import REGISTRY
    text = REGISTRY["label_balance"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "AvgCarrierDelay" not in text and text.count("Join") == 3  # the trip view's own joins


def test_scoring_scans_the_requests_once(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    from tardy.functions import constants as K
    from tardy.operators import ml as M
    model = PipelineModel([SQLTransformer(statement="SELECT *, DepHour * 2.0 AS prediction FROM __THIS__")])
    feats = spark.range(10).select(F.col("id").cast("string").alias("request_id"), F.lit("A").alias("model_type"),
                                   *[F.lit(1.0).alias(c) for c in K.NUMERIC_FEATURES_WITH_DEP])
    plan = M.score_regression(feats, model, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0") == 1 and "Union" not in plan
