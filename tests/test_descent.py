"""Descents from the root against a walk query by query."""

import random

import pytest
from loamgraph.operators import descend
from loamgraph.operators.graph import ROOT, Graph
from loamgraph.plans.engine import Engine
from pyspark.sql import functions as F

NODES = "id string, name string, content string, node_class string, hub boolean, seq long"
EDGES = "id string, source_id string, target_id string, type string, priority double"
WORDS = ["ash", "birch", "cedar", "fir", "larch"]


def tree(spark, seed, root=True):
    rng = random.Random(seed)
    ids = ([ROOT] if root else []) + [f"n{i}" for i in range(60)]
    names = {n: f"{rng.choice(WORDS)} {rng.choice(WORDS)}" for n in ids}
    nodes = [(n, names[n], None, "concept", n in ("n0", "n3"), i) for i, n in enumerate(ids)]
    ends = {(ROOT, f"n{i}", "assoc") for i in range(6)} if root else set()
    ends |= {(rng.choice(ids[1:]), rng.choice([*ids, "gone"]), rng.choice(["assoc", "assoc", "mutex"])) for _ in range(160)}
    edges = [(f"{a}>{b}:{t}", a, b, t, 0.0) for a, b, t in sorted(ends) if a != b]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)), {n: (names[n], i) for i, n in enumerate(ids)}, edges


def walk(names, edges, starts, query, depth, most):
    words = set((query or "").split())
    below = {}
    for _, a, b, t, _ in edges:
        if t == "assoc" and b in names:
            below.setdefault(a, set()).add(b)
    seen, frontier, landed = set(starts), list(starts), []
    for level in range(1, depth + 1):
        shown = {c for f in frontier for c in below.get(f, ())} - seen
        scores = {c: len(words & set(names[c][0].split())) for c in shown}
        chosen = sorted((c for c in shown if scores[c]), key=lambda c: (-scores[c], names[c][1], c))
        seen |= shown
        landed += [(c, level) for c in chosen]
        frontier = chosen
        if not chosen:
            break
    if landed:
        return landed[:most]
    top = below.get(ROOT, set()) if starts == [ROOT] else set(starts)
    return [(c, 0) for c in sorted(top, key=lambda c: names[c][1])[:most]]


@pytest.mark.parametrize(("seed", "root", "depth", "most"), [(1, True, 3, 10), (2, True, 2, 3), (3, False, 3, 10), (4, True, 4, 100)])
def test_descents_are_walks(spark, seed, root, depth, most):
    g, names, edges = tree(spark, seed, root)
    queries = [(i, " ".join(random.Random(i).sample(WORDS, 1 + i % 2))) for i in range(8)] + [(20, "none"), (21, None), (22, ""), (1, "zebra")]
    got = {}
    for r in sorted(descend.descend(g, spark.createDataFrame(queries, "query_id int, query string"), depth=depth, most=most).collect()):
        got.setdefault(r.query_id, []).append((r.level, r.place, r.id))
    starts = [ROOT] if root else ["n0", "n3"]
    asked = {i: min((x for j, x in queries if j == i and x is not None), default=None) for i, _ in queries}
    assert {q: [(n, lv) for lv, _, n in sorted(rows)] for q, rows in got.items()} == {q: walk(names, edges, starts, text, depth, most) for q, text in asked.items()}


def test_only_what_was_shown_is_taken(spark):
    g, _, _ = tree(spark, 1)
    odd = lambda c: c.sparkSession.createDataFrame([(1, "n59", 1), (1, "nowhere", 2), (1, "n2", 4), (1, "n2", 3)], "query_id int, id string, place int")
    got = descend.descend(g, spark.createDataFrame([(1, "x")], "query_id int, query string"), odd, depth=1)
    assert [tuple(r) for r in got.collect()] == [(1, "n2", 1, 1)]


def test_no_queries_and_an_engine_that_goes_down(spark):
    g, _, _ = tree(spark, 1)
    q = spark.createDataFrame([(1, "unknown")], "query_id int, query string")
    assert descend.descend(g, q.limit(0)).count() == 0
    deep = lambda c: c.where("id in ('n1', 'n2')").select("query_id", "id", F.col("seq").alias("place"))
    assert {r.id for r in Engine(spark, g, chooser=deep).locate(q).collect()} == {"n1", "n2"}
