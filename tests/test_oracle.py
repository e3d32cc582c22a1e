"""Every registered query against its oracle SQL, whole tables, smallest scale, and the shape of its plan."""

import pytest

from __spark_entry__ import entry
from cellframe.plans import all_oracles as oracle_sql, all_queries as queries
from check import compare, connect

ORACLES = oracle_sql()
# image kernels and sequential trackers; everything else stays in Spark SQL
PYTHON = ("g18_", "b2_", "b5_", "b8_", "b12_medial", "m3_", "m4_", "m5_", "m6_", "k5_", "k9_", "k10_", "p3_", "p5_")


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not name.startswith(PYTHON):
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    ok, note = compare(df, con, ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 7


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
