"""No query's plan explodes: expressions that are read more than once are columns of their own."""

import pytest

from kelpline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_short(spark, name):
    assert len(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()) < 100_000
