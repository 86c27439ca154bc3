"""Searches of the queries themselves: nothing of theirs goes through the driver by broadcast."""

import pytest

from stocktide.operators import match
from stocktide.plans import inventory, registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [inventory.nearest_same_digits, registry.nearest_sku_topk])
def test_a_search_of_identifiers_broadcasts_nothing(spark, monkeypatch, query):
    """A shortened text is one of a hundred of its identifier; the planner takes all of them for a few kilobytes."""
    plans, keep = [], match.stored
    monkeypatch.setattr(match, "stored", lambda df, name: plans.append(plan_of(df)) or keep(df, name))
    plans.append(plan_of(query(spark, "/root/testdata/sf0.001")))
    assert len(plans) >= 5 and not [p for p in plans if "Broadcast" in p]
