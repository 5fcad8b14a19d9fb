import pytest
from oracle import check

import __spark_entry__ as entry
from lodestrata.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_extent_plan_prunes_and_aggregates_partially(spark, sf):
    plan = catalog.queries()["extent_group"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Python" not in plan
    scan = plan[plan.index("ReadSchema") :]
    assert "l_extendedprice" in scan and "l_partkey" not in scan
