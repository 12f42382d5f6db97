"""Best texts by bounds, and paths from both ends, against the plain ways."""

import random

import pytest
from loamgraph.operators import iterate, rank
from loamgraph.operators.graph import Graph
from pyspark.sql import Window
from pyspark.sql import functions as F

NODES = "id string, name string, content string, node_class string, hub boolean, seq long"
EDGES = "id string, source_id string, target_id string, type string, priority double"


def plain(queries, texts, top, title):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = rank.lexical_search(queries, texts, title).withColumn("_nth", place).where(F.col("_nth") <= top)
    return sorted((r.query_id, r.id, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize(("top", "title"), [(1, None), (3, None), (3, "title"), (500, "title")])
def test_best_texts_are_those_of_all_pairs(spark, top, title):
    rng = random.Random(top)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    some = lambda n: " ".join(rng.choices(words, weights, k=n))
    texts = [(i, some(rng.randrange(1, 25)), some(3)) for i in range(200)] + [(200 + i, "w0 w1 w2", "w0") for i in range(60)]
    texts += [(900, None, None), (901, "", "w39"), (902, "w39 w38 w37", None)]
    queries = [(i, some(rng.randrange(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, "w0 w1 w2"), (53, "w0 w1 w2")]
    q = spark.createDataFrame(queries, "query_id int, query string")
    t = spark.createDataFrame(texts, "id int, text string, title string")
    got = rank.best_texts(q, t, top, title)
    assert sorted((r.query_id, r.id, round(r.score, 9)) for r in got.collect()) == plain(q.distinct(), t, top, title)


def test_no_texts_and_no_queries(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    t = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert rank.best_texts(q.limit(0), t, 3).count() == 0
    assert rank.best_texts(q, t.limit(0), 3).count() == 0


def graph(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(40)]
    nodes = [(n, n, n, rng.choice(["concept", "fact", "event", "source"]), False, i) for i, n in enumerate(ids)]
    ends = {(rng.choice([*ids, "gone"]), rng.choice([*ids, "gone", "lost"]), rng.choice(["assoc", "assoc", "mutex"])) for _ in range(55)}
    edges = [(f"{a}>{b}:{t}", a, b, t, 0.0) for a, b, t in sorted(ends)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)), ids


@pytest.mark.parametrize(("seed", "most"), [(1, 6), (2, 3), (3, 0)])
def test_paths_are_the_least_of_the_shortest(spark, seed, most):
    g, ids = graph(spark, seed)
    beside = {}
    for r in g.neighbours().collect():
        beside.setdefault(r.me, []).append(r.other)
    pairs = [(a, b) for a in ids[::5] for b in ids[::3]] + [("n0", "gone"), ("absent", "n1"), ("n1", "n1"), ("n1", "n1")]
    expected = {}
    for source, target in set(pairs):
        level, seen = {source: (source,)}, set()
        for _ in range(most + 1):
            if source not in ids or target not in ids:
                break
            if target in level:
                expected[source, target] = level[target]
                break
            seen |= set(level)
            grown = {}
            for at, way in level.items():
                for other in set(beside.get(at, [])) - seen:
                    grown[other] = min(grown.get(other, (*way, other)), (*way, other))
            level = grown
    got = iterate.shortest_paths(g, spark.createDataFrame(pairs, "source string, target string"), most).collect()
    assert len(got) == len(expected) and {(r.source, r.target): tuple(r.path) for r in got} == expected


def test_steps_are_the_neighbours_at_some_nodes(spark):
    g, ids = graph(spark, 7)
    near = {*ids[:9], "gone"}
    rows = {(r.me, r.other) for r in g.neighbours().collect()}
    some = spark.createDataFrame([(i,) for i in near], "id string")
    assert {tuple(r) for r in g.steps(some).collect()} == {r for r in rows if r[0] in near}
    assert {tuple(r) for r in g.steps(some, back=True).collect()} == {r for r in rows if r[1] in near}
