import pytest
from conftest import plan_of

import check
from __spark_entry__ import entry
from hooktrace.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["source_feed", "risk_level", "count"]
    assert sum(r["count"] for r in frame.collect()) == 1000


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    """Same rows as the SQL, by a plan without pairwise joins and without Python."""
    frame = QUERIES[name](spark, SF)
    plan = plan_of(frame)
    physical = plan[plan.index("== Physical Plan"):]
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in physical, bad
    good, note = check.compare(con, name, frame)
    assert good, note
