"""Queries over all edges meet them with nodes as few times as they need, and give what the longer ways gave."""

import random

from loamgraph.operators import budget, ingest, quality
from loamgraph.operators.graph import Graph
from loamgraph.plans import queries
from loamgraph.sources import derive
from test_semantics import graph

SF = "/root/testdata/sf0.001"


def _joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_active_view_costs_pass_over_edges_once(spark):
    """Repeated pairs, self loops, unknown ends and mutex edges count as they did, with edges met with nodes three times, not eight."""
    ids = "abcd"
    nodes = spark.createDataFrame([(i, "n" * (3 * k + 3), "t" * 7 * k, "fact", False, None, None, k) for k, i in enumerate(ids)], "id string, name string, content string, node_class string, hub boolean, doc_id string, event_ts string, seq long")
    links = [("a", "b", "assoc"), ("a", "b", "assoc"), ("a", "b", "mutex"), ("b", "a", "mutex"), ("c", "c", "assoc"), ("a", "x", "assoc"), ("x", "a", "assoc"), ("d", "c", "mutex")]
    edges = spark.createDataFrame([(f"{k}", s, t, kind, 0.0) for k, (s, t, kind) in enumerate(links)], "id string, source_id string, target_id string, type string, priority double")
    g = Graph(nodes, edges)
    own = {r.id: r.tokens for r in budget.node_costs(nodes).collect()}
    cost = {r.id: r.tokens for r in budget.edge_costs(g).collect()}
    want = dict(own)
    for k, (s, t, _) in enumerate(links):
        for end in (s, t):
            want[end] = want.get(end, 0) + cost[str(k)]
    for s, t in {(s, t) for s, t, kind in links if kind == "assoc" and t in own}:
        want[s] = want.get(s, 0) + own[t]
    got = budget.active_view_costs(g)
    assert {r.id: r.tokens for r in got.collect()} == {i: want[i] for i in ids}
    assert _joins(got) <= 3


def test_core_nodes_without_relations_meet_with_events_only(spark):
    """A core node sees what isn't an event, unknown ends and events by mutex; the rows of ``relations`` say the same."""
    rng = random.Random(5)
    classes = {f"n{i}": ("concept", "fact", "event", "source")[i % 4] for i in range(24)}
    nodes = spark.createDataFrame([(i, i, "", c, False, None, None, k) for k, (i, c) in enumerate(classes.items())], "id string, name string, content string, node_class string, hub boolean, doc_id string, event_ts string, seq long")
    for round_ in range(3):
        ends = [(f"n{rng.randrange(26)}", f"n{rng.choice([2, 6, 10, 14, 25, rng.randrange(24)])}", rng.choice(["assoc", "assoc", "mutex"])) for _ in range(14)]
        edges = spark.createDataFrame([(f"{k}", s, t, kind, 0.0) for k, (s, t, kind) in enumerate(ends)], "id string, source_id string, target_id string, type string, priority double")
        g = Graph(nodes, edges)
        seen = {r.me for r in g.relations().collect()}
        want = {i for i, c in classes.items() if c in ("concept", "fact") and i not in seen}
        loose = ingest.roots_to_hang(g)
        assert {r.id for r in loose.collect()} == want and want
        changed = nodes.where("seq < 9").select("id")
        assert {r.id for r in ingest.roots_to_hang(g, changed).collect()} == {i for i in want if int(i[1:]) < 9}
    assert _joins(loose) == 3


def test_report_delta_only_counts(spark):
    """Sizes are counted where nodes and edges are read: what goes with events is all that nodes and edges meet with."""
    g = derive.derive_graph(spark, SF)
    delta = queries.report_delta(spark, SF)
    got = {r.metric: (r.before, r.after) for r in delta.collect()}
    n, e = (g.nodes.where("id like 'e:%'").count(), g.edges.where("source_id like 'e:%'").count())
    assert got == {"nodes": (g.nodes.count(), g.nodes.count() - n), "edges": (g.edges.count(), g.edges.count() - e)}
    without = g.without_nodes(g.of_class("event").select("id"))
    longer = quality.report_delta(*(quality.graph_quality(x).select("nodes", "edges") for x in (g, without)))
    assert _joins(delta) <= _joins(longer) - 6


def test_health_passes_over_edges_once_more(spark):
    """Counts of types and of repeated pairs come of one pass; children meet with nodes once."""
    kinds = [("a", "b", "assoc"), ("a", "b", "assoc"), ("a", "b", "assoc"), ("b", "a", "mutex"), ("b", "a", "mutex"), ("a", "gone", "assoc"), ("a", "gone", "assoc"), ("b", "c", "assoc")]
    g = graph(spark, {"a": {"content": "x" * 90}, "b": {"cls": "fact"}, "c": {"cls": None}}, kinds)
    out = quality.health(g, 20)
    got = {r.check: r.n for r in out.collect()}
    assert got == {"class concept": 1, "class fact": 1, None: 1, "type assoc": 6, "type mutex": 2, "over budget": 1, "repeated pairs": 2}
    assert {r.id: r.members for r in budget.hierarchy_costs(g).collect()} == {"a": 1, "b": 1, "c": 0}
    assert _joins(out) == 2
    none = quality.health(Graph(g.nodes, g.edges.limit(0)), 20).where("check = 'repeated pairs'").collect()
    assert [r.n for r in none] == [0]
