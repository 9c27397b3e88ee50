"""Leaves of JSON-LD are many for each block; joins with them must not be broadcast, however small the blocks look."""

import pytest

from siteglass.plans import jsonld


@pytest.mark.parametrize("query", [jsonld.j2n3_resolved, jsonld.j13_nearest, jsonld.j2n6_identities, jsonld.z04_visible_prices])
def test_leaves_are_merged(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
