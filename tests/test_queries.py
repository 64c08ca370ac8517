"""Every registered query against its SQL on the smallest tables, and its plan against what large tables allow."""

import __spark_entry__ as entry_points
import pytest
from newsloom.plans.oracles import ORACLES
from newsloom.plans.queries import QUERIES
from oracle import compare, connect, plan_problems

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["id", "url", "assessment", "assessment_score", "rank"]
    assert df.count() == 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = entry_points.queries()[name](spark, SF)
    assert plan_problems(result) == []
    difference, _ = compare(result, con, entry_points.oracle_sql()[name])
    assert not difference, difference
