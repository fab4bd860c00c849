"""Every registered query with an oracle equals its DuckDB twin (sf0.001)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from conftest import SF_SMALL
from helpers import table

NAMES = sorted(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    s_cols, s_rows = table(sdf.toPandas())
    o_cols, o_rows = table(duck.execute(oracle_sql()[name]).df())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert {"AvgCarrierDelay", "IsRushHour", "RouteFlightCount"} <= set(df.columns)
