"""Stream vs batch: the event-time merge equals its batch twin."""

from conftest import SF_SMALL
from helpers import table
from tardy.catalog import REGISTRY


def test_stream_merge_equals_batch(spark):
    stream = REGISTRY["stream_merge_responses"](spark, SF_SMALL)
    batch = REGISTRY["merged_response"](spark, SF_SMALL)
    assert table(stream.toPandas()) == table(batch.toPandas())


def test_stream_single_equals_batch(spark):
    stream = REGISTRY["stream_single_response"](spark, SF_SMALL)
    batch = REGISTRY["request_response_join"](spark, SF_SMALL)
    assert table(stream.toPandas()) == table(batch.toPandas())


def test_stream_single_classification_equals_batch(spark):
    stream = REGISTRY["stream_single_classification"](spark, SF_SMALL)
    batch = REGISTRY["classification_response_join"](spark, SF_SMALL)
    assert table(stream.toPandas()) == table(batch.toPandas())


def test_fan_out_sends_each_request_twice(spark):
    out = REGISTRY["stream_fan_out"](spark, SF_SMALL)
    valid = REGISTRY["valid_requests"](spark, SF_SMALL).count()
    assert out.count() == 2 * valid
    assert {r.topic for r in out.select("topic").distinct().collect()} == {
        "input-regression", "input-classification"}


def test_stream_scoring_equals_batch_scoring(spark):
    for kind in ("regression", "classification"):
        stream = REGISTRY[f"stream_score_{kind}"](spark, SF_SMALL)
        batch = REGISTRY[f"score_{kind}"](spark, SF_SMALL)
        assert table(stream.toPandas()) == table(batch.toPandas())
