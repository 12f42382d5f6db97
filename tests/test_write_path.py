"""Ingests that repeat, outgrow the budget, are saved and streamed: nothing is lost or done twice."""

import random
import re

import pytest
from loamgraph.operators import budget, compact, ingest, link
from loamgraph.operators.graph import Graph
from loamgraph.plans.engine import Engine
from loamgraph.sources import changes, ledger, store
from loamgraph.streaming.ingest import ingest_once, newest_events, newest_of, write_graph
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_semantics import graph, pairs

INPUT = "ingest_id string, content string, ts string, doc_id string, chunk_id string"
DECISION = "ingest_id string, pos int, action string, name string, content string, target_id string, node_class string"


def inputs(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], INPUT)


def creates(spark, *rows):
    return spark.createDataFrame([(i, p, "create", n, c, None, None) for i, p, n, c in rows], DECISION)


def names(g):
    return sorted(r.name for r in g.nodes.where("node_class = 'concept'").collect())


def test_a_name_that_was_used_before_replaces_nothing(spark):
    g = graph(spark, {"k": {"name": "Known"}}, [])
    first = ingest.apply(g, inputs(spark, ("1", "text", "t")), creates(spark, ("1", 0, "Foo", "f"))).graph
    second = ingest.apply(first, inputs(spark, ("1", "other", "t")), creates(spark, ("1", 0, "Bar", "b"))).graph
    third = ingest.apply(second, inputs(spark, ("1", "other", "t")), creates(spark, ("1", 0, "Baz", "b"))).graph
    assert names(third) == ["Bar", "Baz", "Foo", "Known"]
    assert third.nodes.where("node_class = 'event'").count() == 2


def test_places_are_told_apart_by_ingest(spark):
    g = graph(spark, {"k": {}}, [])
    done = ingest.apply(g, inputs(spark, ("1", "one", "t"), ("2", "two", "t")), creates(spark, ("1", 0, "Foo", "f"), ("2", 0, "Bar", "b"), ("2", 1, "foo", "again")))
    nodes = {r.name: r for r in done.graph.nodes.collect()}
    assert nodes["Foo"].content == "f\nagain" and nodes["Bar"].content == "b"
    ends = {(r.source_id, r.target_id) for r in done.graph.edges.collect()}
    assert ends == {(nodes["one"].id, nodes["Foo"].id), (nodes["two"].id, nodes["Foo"].id), (nodes["two"].id, nodes["Bar"].id)}
    with pytest.raises(ValueError, match="repeat place"):
        ingest.apply(g, inputs(spark, ("1", "one", "t")), creates(spark, ("1", 0, "Foo", "f"), ("1", 0, "Bar", "b")))


def test_a_chunk_is_updated_twice(spark):
    engine = Engine(spark, graph(spark, {"k": {"name": "Known"}}, []), task_budget=1000)
    for content, name in (("a", "A"), ("b", "B"), ("c", "C")):
        chunks = spark.createDataFrame([("1", content)], "chunk_id string, content string")
        engine = engine.update_document("d", chunks, creates(spark, ("d/1", 0, name, name)))
    assert names(engine.graph) == ["A", "B", "C", "Known"] and engine.graph.nodes.where("node_class = 'event'").count() == 3
    assert names(engine.purged().graph) == ["C", "Known"]


def test_an_ingest_beyond_the_budget_is_compacted(spark):
    g = graph(spark, {"c": {"name": "centre"}}, [])
    g = Graph(g.nodes, g.edges.withColumn("weight", F.lit(1.5)))
    colours = ["red", "blue"]
    rows = [("i", k, "create", f"m{k}", f"{colours[k % 2]} thing {k} {'z' * 30}", None, None) for k in range(12)]
    anchors = spark.createDataFrame([*rows, ("i", 99, "merge", "centre", "", "c", None)], DECISION).withColumn("edges_to_names", F.when(F.col("pos") == 99, F.array(*(F.lit(f"m{k}") for k in range(12)))))
    engine = Engine(spark, g, task_budget=100).ingest(inputs(spark, ("i", "text", "t", "d", "1")), anchors)
    costs = {r.id: r.tokens for r in budget.neighbourhood_costs(engine.graph).collect()}
    hubs = engine.graph.nodes.where("hub").collect()
    assert costs["c"] <= 100 and {r.content for r in hubs} == {"blue", "red"} and hubs[0].aliases is None
    assert "weight" in engine.graph.edges.columns and engine.graph.nodes.where("size(sources) = 1").count() == 13


@pytest.mark.parametrize("seed", range(2))
def test_compaction_of_what_changed_is_compaction(spark, seed):
    """The form that looks at what changed against one that costs all neighbourhoods anew each round."""
    rng = random.Random(seed)
    words = ["red", "blue", "green"]
    nodes = {f"n{i}": {"content": f"{rng.choice(words)} {rng.choice(words)} {'z' * rng.randrange(40)}"} for i in range(40)}
    drawn = {(rng.choice(list(nodes)[:6]), rng.choice(list(nodes))) for _ in range(90)}
    g = graph(spark, nodes, [(a, b, "assoc") for a, b in drawn if a != b])

    def rounds(g, limit):
        failed = set()
        for _ in range(20):
            before = {r.id: r for r in budget.neighbourhood_costs(g).collect()}
            over = [i for i, r in before.items() if r.tokens > limit and r.members >= 2 and i not in failed]
            if not over:
                return g
            centres = spark.createDataFrame([(i,) for i in over], "center string")
            down = g.drill_down()
            texts = g.nodes.select("id", "name", "content")
            plan = compact._planned(centres, down, texts, compact.by_first_word).select("center", "hub", "theme", "id")
            hubs = plan.select(F.col("hub").alias("id"), "theme").distinct().join(g.nodes.select("id"), "id", "left_anti")
            made = hubs.selectExpr("id", "theme name", "theme content", "'concept' node_class", "true hub", "null doc_id", "null event_ts", "0L seq").select(g.nodes.columns)
            tried = Graph(g.nodes.unionByName(made), compact.reorganised_edges(g.edges, plan.select("center", "hub", "id")))
            now = {r.id: r.tokens for r in budget.neighbourhood_costs(tried).collect()}
            better = [i for i in over if now[i] < before[i].tokens]
            failed |= set(over) - set(better)
            kept = plan.where(F.col("center").isin(better))
            used = {r.hub for r in kept.collect()}
            g = Graph(g.nodes.unionByName(made.where(F.col("id").isin(list(used)))), compact.reorganised_edges(g.edges, kept.select("center", "hub", "id")))
            g = Graph(spark.createDataFrame(g.nodes.collect(), g.nodes.schema), spark.createDataFrame(g.edges.collect(), g.edges.schema))
        return g

    want = rounds(g, 90)
    everything = compact.compact(g, 90)
    ids = spark.createDataFrame([(i,) for i in nodes], "id string")
    for got in (everything, compact.compact(g, 90, changed=ids)):
        assert pairs(got.edges.select("source_id", "target_id")) == pairs(want.edges.select("source_id", "target_id"))
        assert pairs(got.nodes.select("id", "content")) == pairs(want.nodes.select("id", "content"))
    assert compact.compact(g, 90, changed=ids.limit(0)).nodes.count() == 40  # what didn't change is left alone
    again = compact.compact(everything, 90)
    assert pairs(again.nodes.select("id")) == pairs(everything.nodes.select("id"))


def test_what_was_ingested_is_saved(spark, tmp_path):
    g = graph(spark, {"k": {"name": "Known"}}, [])
    g = Graph(g.nodes, g.edges.withColumn("weight", F.lit(1.5)))
    chunk = inputs(spark, ("d/1", "text", "t", "d", "1"))
    Engine(spark, g, task_budget=1000).ingest(chunk, creates(spark, ("d/1", 0, "Known", "more"))).save(str(tmp_path))
    back = Engine.from_folder(spark, str(tmp_path), task_budget=1000)
    assert "weight" in back.graph.edges.columns and back.graph.edges.count() == 1
    again = back.ingest(chunk, creates(spark, ("d/1", 0, "Known", "more")))
    node = again.graph.nodes.where("id = 'k'").first()
    assert [s.chunk_id for s in node.sources] == ["1"] and again.graph.nodes.count() == 2
    plan = ingest.new_chunks(chunk, back.done)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_meta_is_written_beside_the_old_one(spark, tmp_path):
    g = graph(spark, {"a": {}}, [])
    store.save(g, str(tmp_path))
    put = lambda k, v: store.set_meta(spark, str(tmp_path), spark.createDataFrame([(k, v)], "key string, value string"))
    put("x", "1")
    put("x", "2")
    put("y", "3")
    assert {r.key: r.value for r in store.meta(spark, str(tmp_path)).where("key in ('x', 'y')").collect()} == {"x": "2", "y": "3"}
    (tmp_path / "v=0" / "meta-9").mkdir()  # not listed, so not read
    store.save(g, str(tmp_path))
    assert {r.key for r in store.meta(spark, str(tmp_path)).collect()} >= {"x", "y"}


def test_dedup_keeps_aliases_and_sources(spark):
    g = graph(spark, {"a": {"name": "n", "content": "x"}, "b": {"name": "n", "content": "y"}, "c": {"name": "n", "content": "x"}}, [])
    source = "array(named_struct('doc_id', 'd', 'chunk_id', id, 'content_hash', 'h'))"
    g = Graph(g.nodes.withColumns({"aliases": F.expr("case when id <> 'a' then array(concat('alias ', id)) end"), "sources": F.expr(f"case id when 'a' then slice({source}, 1, 0) else {source} end")}), g.edges)
    done = link.dedup(g)
    node = done.nodes.first()
    assert done.nodes.count() == 1 and node.aliases == ["alias b", "alias c"] and [s.chunk_id for s in node.sources] == ["b", "c"]
    assert ingest.orphans(done.nodes).count() == 0


def test_summaries_are_rendered(spark):
    g = graph(spark, {"c": {}, "m": {"content": "x" * 300}}, [("c", "m", "assoc")])
    plain = {r.id: r.tokens for r in budget.neighbourhood_costs(g).collect()}
    told = Graph(g.nodes.withColumn("summary", F.expr("case id when 'm' then named_struct('text', 'short', 'length', 300) end")), g.edges)
    short = {r.id: r.tokens for r in budget.neighbourhood_costs(told).collect()}
    assert short["c"] < plain["c"] - 50 and short["m"] == plain["m"]


def test_edges_are_updated_by_the_rules(spark):
    g = graph(spark, {"a": {}, "b": {"cls": "fact"}}, [("a", "b", "assoc")])
    change = lambda **v: spark.createDataFrame([("a>b:assoc", *v.values())], "id string, " + ", ".join(f"{k} {'double' if k == 'priority' else 'string'}" for k in v))
    assert g.updated_edges(change(priority=2.5)).edges.first().priority == 2.5
    for odd in ({"type": "odd"}, {"type": "mutex"}):
        with pytest.raises(ValueError):
            g.updated_edges(change(**odd))


def test_ledger_reads_the_buckets_that_may_know(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(r, "doc_id string, chunk_id string, content_hash string")
    known = [("d", str(i), f"h{i}") for i in range(300)]
    ledger.append(rows(*known), folder, 0)
    ledger.append(rows(("d", "0", "new"), ("d", "1", None)), folder, 1)
    ledger.append(rows(("d", "0", "new"), ("d", "1", None)), folder, 1)  # again
    asked = rows(("d", "0", "h0"), ("d", "0", "new"), ("d", "1", "h1"), ("d", "2", "h2"), ("e", "2", "h2"))
    assert pairs(ledger.fresh(spark, asked, folder)) == [("d", "0", "h0"), ("d", "1", "h1"), ("e", "2", "h2")]
    assert pairs(ledger.fresh(spark, asked, folder, before=1)) == [("d", "0", "new"), ("e", "2", "h2")]
    unknown = rows(*(("x", str(i), "h") for i in range(200)))
    assert ledger.suspects(spark, unknown, folder).count() < 5 and ledger.current(spark, folder).count() == 299
    ledger.folded(spark, folder, f"{folder}/next")
    assert ledger.current(spark, f"{folder}/next").count() == 299
    assert ledger.fresh(spark, asked, f"{folder}/none").count() == 5


def stream(spark, folder, schema, *batches):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_of_chunks_asks_the_ledger(spark, tmp_path):
    schema, out = "doc_id string, chunk_id string, content string", str(tmp_path / "out")
    for batch in ([("d", "1", "x"), ("d", "1", "x"), ("d", "2", "y")], [("d", "1", "x"), ("d", "2", "changed")], [("d", "2", "y")]):
        ingest_once(spark, stream(spark, str(tmp_path / "in"), schema, batch), out, str(tmp_path / "check")).awaitTermination()
    assert pairs(spark.read.parquet(f"{out}/chunks").select("batch", "chunk_id", "content")) == [(0, "1", "x"), (0, "2", "y"), (1, "2", "changed"), (2, "2", "y")]


def test_newest_events_are_state(spark, tmp_path):
    schema = "target_id string, event_id string, event_ts string"
    rng = random.Random(3)
    events = [(f"n{rng.randrange(5)}", f"e{i}", rng.choice([None, str(2000 + rng.randrange(20))])) for i in range(60)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for at in (0, 20, 40):
        newest_events(spark, stream(spark, str(tmp_path / "in"), schema, events[at : at + 20]), out, check, 3).awaitTermination()
    want = []
    for n in sorted({e[0] for e in events}):
        own = sorted((e for e in events if e[0] == n), key=lambda e: e[1])
        want += [(n, k + 1, *e[1:]) for k, e in enumerate(sorted(own, key=lambda e: e[2] or "", reverse=True)[:3])]
    assert sorted(map(tuple, newest_of(spark, out).collect()), key=repr) == sorted(want, key=repr)


def test_a_graph_written_by_a_stream_that_is_killed(spark, tmp_path):
    g = graph(spark, {"k": {"name": "Known", "content": "one"}}, [])
    rows = [[(f"d/{i}", f"text {i}", "t", "d", str(i))] for i in range(4)]
    decide = lambda batch: batch.selectExpr("ingest_id", "0 pos", "'create' action", "case when chunk_id in ('1', '3') then 'known' else 'topic' end name", "concat('about ', chunk_id) content", "cast(null as string) target_id", "cast(null as string) node_class")
    folder, check = str(tmp_path / "graph"), str(tmp_path / "check")
    store.save(g, folder)

    def killed(batch):
        if batch.where("chunk_id = '2'").count() and not killed.once:
            killed.once = True
            raise RuntimeError("killed")
        return decide(batch)

    killed.once = False
    source = stream(spark, str(tmp_path / "in"), INPUT, *rows)
    with pytest.raises(StreamingQueryException):
        write_graph(spark, source, folder, killed, check, fold_every=3).awaitTermination()
    assert len(changes.committed(spark, folder)) == 2
    write_graph(spark, source, folder, killed, check, fold_every=3).awaitTermination()
    got = changes.load(spark, folder)
    one = g
    for batch in rows:
        frame = spark.createDataFrame(batch, INPUT)
        one = ingest.apply(one, frame, decide(frame)).graph
    columns = ["id", "name", "content", "node_class"]
    assert pairs(got.nodes.select(columns)) == pairs(one.nodes.select(columns))
    assert pairs(got.edges.select("source_id", "target_id")) == pairs(one.edges.select("source_id", "target_id"))
    assert changes.done(spark, folder).count() == 4 and store.versions(spark, folder) == [0, 1]
    # a batch that was committed isn't written twice, and a deletion takes its edges along
    assert not changes.commit(spark, folder, "ingest", 3, changes.Changes())
    topic = got.nodes.where("name = 'topic'").select("id")
    changes.commit(spark, folder, "janitor", 0, changes.Changes(gone_nodes=topic))
    left = changes.load(spark, folder)
    assert left.nodes.count() == got.nodes.count() - 1 and left.edges.count() == got.edges.count() - 2
    changes.fold(spark, folder)
    assert store.load(spark, folder).edges.count() == left.edges.count() and changes.logged_since(spark, folder) == 0
