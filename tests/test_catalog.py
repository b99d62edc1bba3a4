import re

import pytest
from oracle import compare

from tidelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.SQL:
        compare(spark, sf, catalog.QUERIES[name], catalog.SQL[name])
    else:
        assert catalog.QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["kv_trivial_move", "kv_replace_tables"])
def test_levels_meet_without_pairs(spark, sf, name):
    """Both levels grow with the store, so the query may not join all pairs of their tables."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin \w+, Inner", plan)
