"""A kept index after updates equals one that is built anew, and is read by bucket."""

import random
import re

import pytest
from loamgraph.operators import search
from loamgraph.operators.graph import Graph
from loamgraph.plans.engine import Engine
from loamgraph.sources import term_index
from loamgraph.sources.term_index import TermIndex
from pyspark.sql import functions as F
from test_semantics import graph
from test_write_path import creates, inputs

NODES = "id string, name string, aliases array<string>"


def nodes(spark, state):
    return spark.createDataFrame([(i, *v) for i, v in state.items()], NODES)


def pairs(df):
    return sorted((r.term, r.id) for r in df.select("term", "id").collect())


def rebuilt(spark, state):
    rows = nodes(spark, state)
    return pairs(search.postings(rows, rows.select("id", F.explode("aliases").alias("alias"))))


def some(rng):
    words = ["a", "b", "a b", "c,d", "", "知识 图", "E e", None]
    aliases = rng.choice([None, [], [rng.choice("abxyz")], ["x y", "b", "x y"]])
    return rng.choice(words), aliases


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_a_rebuilt_index(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(term_index, "FOLD_EVERY", 3)
    rng = random.Random(seed)
    state = {f"n{i}": some(rng) for i in range(12)}
    index = TermIndex.build(nodes(spark, state), str(tmp_path / "index"))
    first, then = index, rebuilt(spark, state)
    for step in range(5):
        changed = {f"n{rng.randrange(16)}": some(rng) for _ in range(4)}
        gone = [f"n{rng.randrange(20)}" for _ in range(3)]
        state = {k: v for k, v in state.items() if k not in gone} | changed
        index = index.updated(nodes(spark, changed), spark.createDataFrame([(g,) for g in gone], "id string"))
        assert pairs(index.postings()) == rebuilt(spark, state)
        if step == 1:
            assert pairs(first.postings()) == then  # an older handle still sees what it saw
    opened = TermIndex.open(spark, str(tmp_path / "index"))
    assert opened == index and len(opened.parts) < 4
    asked = spark.createDataFrame([(1, "b and x"), (2, ""), (3, None), (4, "nothing")], "query_id int, query string")
    got = sorted(map(tuple, opened.lookup(asked).select("query_id", "id", "pos").collect()))
    rows = nodes(spark, state)
    plain = search.lookup(asked, search.postings(rows, rows.select("id", F.explode("aliases").alias("alias"))))
    assert got == sorted(map(tuple, plain.select("query_id", "id", "pos").collect())) and got


def test_odd_rows(spark, tmp_path):
    index = TermIndex.build(nodes(spark, {}), str(tmp_path / "index"))
    assert pairs(index.postings()) == []
    twice = spark.createDataFrame([("n", "a", None), ("n", "b", ["c"]), (None, "d", None), ("m", None, None)], NODES)
    index = index.updated(twice, spark.createDataFrame([("n",), (None,), ("absent",)], "id string"))
    assert pairs(index.postings()) == [("a", "n"), ("b", "n"), ("c", "n")]
    assert pairs(index.updated().postings()) == pairs(index.postings())
    assert TermIndex.open(spark, str(tmp_path / "nowhere")) is None


def test_a_batch_counts_once(spark, tmp_path):
    index = TermIndex.build(nodes(spark, {"n": ("a", None)}), str(tmp_path / "index"))
    index = index.updated(nodes(spark, {"n": ("b", None)}), writer="w", batch=0)
    index = index.updated(nodes(spark, {"n": ("c", None)}), writer="w", batch=1)
    again = TermIndex.open(spark, str(tmp_path / "index")).folded().updated(nodes(spark, {"n": ("b", None)}), writer="w", batch=0)
    assert pairs(again.postings()) == [("c", "n")] and again.writers == {"w": 1}


def test_a_lookup_reads_its_buckets(spark, tmp_path):
    state = {f"n{i}": (f"word{i} common", None) for i in range(300)}
    index = TermIndex.build(nodes(spark, state), str(tmp_path / "index")).updated(nodes(spark, {"n7": ("word7 new", None)}))
    asked = spark.createDataFrame([(1, "word7 word8")], "query_id int, query string")
    found = index.lookup(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert len(filters) == 3  # the full part, and the later one twice
    for f in filters:
        picked = re.search(r"bucket#\d+ IN \(([\d,]+)\)", f)
        assert picked, f
        assert len(picked[1].split(",")) == 2
    assert sorted((r.id, r.pos) for r in found.collect()) == [("n7", 0), ("n8", 1)]


def test_an_ingest_tells_the_index(spark, tmp_path):
    g = graph(spark, {"k": {"name": "Known thing"}}, [])
    engine = Engine(spark, Graph(g.nodes, g.edges), task_budget=1000)
    engine.registry.register("index", "terms", TermIndex.build(g.nodes, str(tmp_path / "index")))
    asked = spark.createDataFrame([(1, "Foo"), (2, "Known")], "query_id int, query string")
    seeds = lambda e: {(r.query_id, r.name) for r in e.locate(asked).join(e.graph.nodes, "id").where("node_class = 'concept'").collect()}
    grown = engine.ingest(inputs(spark, ("1", "text", "t")), creates(spark, ("1", 0, "Foo", "f")))
    now = grown.registry.get("index", "terms")
    rows = term_index.named(grown.graph.nodes)
    assert pairs(now.postings()) == pairs(search.postings(rows, rows.select("id", F.explode("aliases").alias("alias"))))
    assert (1, "Foo") in seeds(grown) and (2, "Known thing") in seeds(grown)
    assert not now.lookup(asked).where("query_id = 1").isEmpty() and engine.registry.get("index", "terms").lookup(asked).where("query_id = 1").isEmpty()
