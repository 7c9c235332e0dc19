"""What rounds of a search over edges shuffle."""

from __future__ import annotations

from veriframe.operators import graph


def test_links_are_not_shuffled_again(spark):
    edges = spark.createDataFrame([(f"a{i % 50}", f"b{i % 70}") for i in range(700)], "source_id string, target_id string")
    links = graph._links(edges)
    assert links.count() == len({(i % 50, i % 70) for i in range(700)})
    front = spark.createDataFrame([("x", "a1")], "source string, node string").hint("merge")
    plan = front.join(links, front["node"] == links["source_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the front


def test_sources_without_own_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "source_id string, target_id string")
    asked = spark.createDataFrame([("a",), ("c",), ("none",), ("a",)], "source string")
    assert sorted(map(tuple, graph.reach(edges, asked).collect())) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("c", "c", 0)]
