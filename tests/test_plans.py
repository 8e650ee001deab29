"""Plan shape of the flagship job: pruned scan, equi-joins only, small branches."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_plans(spark):
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    from doppel.operators.pairs import match_edges, person_features
    from doppel.sources.fixtures import fixture
    persons = fixture(spark, SF, "persons")
    scan = plan_of(person_features(persons))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", scan)) == {"struct<c_custkey:bigint,c_nationkey:int>"}
    joins = plan_of(match_edges(persons))
    assert "CartesianProduct" not in joins and "BroadcastNestedLoopJoin" not in joins
    # the branches read the written features, not the person table
    assert "ReadSchema" not in joins
