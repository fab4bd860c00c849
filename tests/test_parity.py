"""Train/serve parity: the same trips through the training expressions and
through request scoring give equal derived columns."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tardy.catalog import _reg
from tardy.functions import features as X
from tardy.operators import serving as V
from tardy.operators import stats as S
from tardy.plans.sizing import materialize
from tardy.sources.schemas import REQUEST_SCHEMA


def test_training_and_serving_features_agree(spark):
    # ids are assigned on stored rows, so both uses below see the same ids
    train = materialize(_reg(spark, SF_SMALL).filter(F.col("DepHour").isNotNull())) \
        .withColumn("request_id", F.monotonically_increasing_id().cast("string"))
    req = train.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in train.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA.fields])
    served = V.request_features(req, S.compute_stats(train))
    cols = ["TimeOfDay", "DistanceCategory", "IsWeekend", "IsRushHour"]
    left = train.select("request_id", *[F.col(c).alias(f"t_{c}") for c in cols[:3]],
                        X.is_rush_hour("DepHour").alias("t_IsRushHour"))
    j = left.join(served.select("request_id", *cols), "request_id")
    assert j.count() == train.count()
    mismatch = j.filter(" OR ".join(f"NOT (t_{c} <=> {c})" for c in cols)).count()
    assert mismatch == 0
    # lookups on known keys return the training averages, not the miss defaults
    hits = served.filter(F.col("AvgCarrierDelay") == 60.0).count()
    assert hits < served.count()
