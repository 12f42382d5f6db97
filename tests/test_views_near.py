"""A view is made of what is around its focus, and is what whole adjacency gives."""

import pytest
from loamgraph.operators import graph as graphs
from pyspark.sql import functions as F
from test_semantics import graph, pairs


@pytest.mark.parametrize("few", [500_000, 0])
def test_view_of_a_focus(spark, monkeypatch, few):
    monkeypatch.setattr(graphs, "FEW", few)
    nodes = {"a": {}, "b": {"cls": "fact"}, "c": {"cls": "event"}, "d": {"cls": "event"}, "e": {"cls": None}, "f": {"cls": "source"}}
    edges = [("a", "b", "assoc"), ("a", "b", "mutex"), ("b", "a", "assoc"), ("c", "a", "assoc"), ("a", "d", "assoc"), ("a", "gone", "assoc"), ("lost", "a", "assoc"), ("e", "c", "assoc"), ("a", "a", "assoc"), ("f", "b", "assoc"), ("d", "d", "mutex")]
    g = graph(spark, nodes, edges)
    focus = spark.createDataFrame([("a",), ("c",), ("c",), ("gone",)], "me string")
    known, seen = g.view(focus)
    around = g.neighbours().join(focus.distinct(), "me").where("me <> other")
    assert pairs(known) == pairs(around.join(g.degrees().withColumnRenamed("id", "other"), "other").select("me", "other", "degree")) and pairs(known)
    down = g.drill_down().select("me", F.concat(F.lit("hierarchy::"), "me", F.lit("::"), "child").alias("edge_id"), F.col("child").alias("other"))
    assert pairs(seen) == pairs(down.unionByName(g.relations().select("me", "edge_id", "other")).join(focus.distinct(), "me").select("me", "edge_id", "other"))
    if few:  # the focus is sent to where edges are read
        assert "strategy=broadcast" in seen._jdf.queryExecution().optimizedPlan().toString()
    cls = {i: n.get("cls", "concept") for i, n in nodes.items()}
    hidden = lambda me, other, t: cls[me] in ("concept", "fact", None) and t == "assoc" and cls.get(other) == "event"
    ends = [(x, y, t) for x, y, t in edges] + [(y, x, t) for x, y, t in edges if x != y]
    relations = [(x, y) for x, y, t in ends if x in nodes and not hidden(x, y, t)]
    down = {(x, y) for x, y, t in edges if t == "assoc" and y in nodes}
    assert pairs(g.relations().select("me", "other")) == sorted(relations)
    assert pairs(g.neighbours()) == sorted({*relations, *down})
    assert pairs(g.degrees()) == sorted((i, sum(m == i for m, _ in [*relations, *down])) for i in nodes)
