"""What queries sent by broadcast when they had run, adaptive changes included, over two sizes of the catalogue."""

import pytest
from pyspark.sql import functions as F

from stocktide.plans import inventory, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    """Folders of the parts as they are and of eight times as many, with shifted keys."""
    part, larger = spark.read.parquet(f"{SF}/part.parquet"), str(tmp_path_factory.mktemp("x8"))
    shifted = part.crossJoin(spark.range(8)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * part.count()).drop("id")
    shifted.write.parquet(f"{larger}/part.parquet")
    return SF, larger


def sent(spark, query, folder):
    """Sizes of all tables that were broadcast while the query ran, those of the tables it stores on its way too."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    executions = store.executionsList()
    known = {executions.apply(i).executionId() for i in range(executions.size())}
    query(spark, folder).write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty()
    executions, found = store.executionsList(), []
    ran = [e for e in (executions.apply(i).executionId() for i in range(executions.size())) if e not in known]
    for e in ran:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics() if node.name().startswith("BroadcastExchange") else None
            for m in (metrics.apply(i) for i in range(metrics.size() if metrics else 0)):
                if m.name() == "data size" and values.contains(m.accumulatorId()):
                    found.append(values.apply(m.accumulatorId()))
    assert ran
    return sorted(found)


def test_a_broadcast_is_seen(spark):
    assert len(sent(spark, lambda s, _: s.range(9).join(F.broadcast(s.range(5)), "id"), "")) == 1


@pytest.mark.parametrize("query", [inventory.nearest_same_digits, registry.nearest_sku_topk])
def test_searches_send_nothing(spark, sizes, query):
    assert [sent(spark, query, folder) for folder in sizes] == [[], []]


@pytest.mark.parametrize("query", [registry.rule_cascade, inventory.suggested_rules])
def test_matching_sends_the_same_over_a_larger_catalogue(spark, sizes, query):
    """The signature plan at most, once for either side: a row for every two sizes of a name."""
    small, large = [sent(spark, query, folder) for folder in sizes]
    assert small == large and len(small) <= 2
