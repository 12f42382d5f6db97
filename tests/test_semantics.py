"""Literal cases for what the SQL comparison can't show: CJK, order, asymmetry, folds, parsers, writes."""

import json
import random
import zlib

import pytest
from loamgraph.functions import parse
from loamgraph.functions import text as tx
from loamgraph.operators import budget, compact, ingest, iterate, link, maintain, rank, search
from loamgraph.operators.graph import ROOT, Graph, check_classes, edge_faults
from loamgraph.plans.engine import Engine, Registry
from loamgraph.sources import store
from loamgraph.streaming.ingest import hourly_counts, ingest_once, newest_events, newest_of, timeline
from pyspark.sql import Window
from pyspark.sql import functions as F

NODE = "id string, name string, content string, node_class string, hub boolean, doc_id string, event_ts string, seq long"
EDGE = "id string, source_id string, target_id string, type string, priority double"


def graph(spark, nodes, edges):
    rows = [(i, n.get("name", i), n.get("content", ""), n.get("cls", "concept"), n.get("hub", False), n.get("doc"), n.get("ts"), k) for k, (i, n) in enumerate(nodes.items())]
    made = [(f"{a}>{b}:{t}", a, b, t, 0.0) for a, b, t in edges]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(made, EDGE))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_estimates(spark):
    est = lambda text, family="unknown": value(spark, tx.estimate(F.lit(text), family))
    assert [est(t) for t in ("", None, "a", "abcdef", "深度学习", "深度学习 abc")] == [0, 0, 1, 2, 6, 7]
    assert est("深度学习 abcd", "deepseek") == 6


def test_tokens(spark):
    assert value(spark, tx.tokens(F.lit("深度 deep，learning。x?"))) == ["深", "度", "深度", "deep", "learning", "x"]
    assert value(spark, tx.token_set(F.lit("What is the Deep deep net"))) == ["deep", "net"]


def test_rendering(spark):
    line = lambda purpose, focus, content="c" * 300: value(spark, tx.render_node(F.lit("1"), F.lit("n"), F.lit(content), F.lit("short"), purpose, F.lit(focus)))
    assert line("arbitrate", True) == "- n (id=1)\n  short"
    assert line("decide_hub", False) == "- n (id=1)\n  short"
    assert line("decide_hub", True) == "- n (id=1)\n  " + "c" * 300
    assert line("select_facts", True, "n") == "- n (id=1)"


def test_names_and_chunks(spark):
    assert value(spark, tx.event_name(F.lit("  a \n b "))) == "a b" and value(spark, tx.event_name(F.lit(" "))) == "ingest"
    assert value(spark, tx.short_name(F.lit("first\nsecond"))) == "first" and value(spark, tx.short_name(F.lit(""))) == "hub"
    assert value(spark, tx.norm_name(F.lit("\t A b\n"))) == "a b"
    sentence = "word " * 99 + "end. "
    chunks = value(spark, tx.chunk_body(F.lit("T"), F.lit("one\n\n  two \n" + sentence * 5)))
    assert chunks[:2] == ["T: one", "two"] and [len(c) for c in chunks[2:]] == [999, 999, 499]
    assert value(spark, tx.chunk_body(F.lit("T"), F.lit("\n".join("abcdefghij")), 8)) == ["T: a", *"bcdefgh"]
    assert value(spark, tx.chunk_body(F.lit("T"), F.lit(" \n "))) == []


def test_chunks_of_a_long_body_are_all_there(spark):
    body = F.lit("\n".join("abcdefghijkl"))
    assert value(spark, tx.chunk_body(F.lit("T"), body)) == ["T: a", *"bcdefghijkl"]
    assert value(spark, tx.chunk_body(F.lit("T"), body, max_chunks=8)) == ["T: a", *"bcdefgh"]


def test_vacuous_labels(spark):
    check = lambda t: value(spark, tx.is_vacuous(F.lit(t)))
    assert [check(t) for t in ("ab", None, "Various Topics here", "其他内容", "graph memory")] == [True, True, True, True, False]
    assert value(spark, tx.ranked_indices(F.lit("3, 1,7 3 99 none"), F.lit(9))) == [2, 0, 6]


def test_core_nodes_do_not_see_events(spark):
    g = graph(spark, {"c": {}, "e": {"cls": "event"}, "s": {"cls": "source"}}, [("e", "c", "assoc"), ("s", "c", "assoc")])
    assert pairs(g.relations().select("me", "other")) == [("c", "s"), ("e", "c"), ("s", "c")]
    assert pairs(g.related_events().select("node_id", "event_id")) == [("c", "e")]
    paths = iterate.shortest_paths(g, spark.createDataFrame([("e", "c"), ("c", "e"), ("c", "c")], "source string, target string"))
    assert pairs(paths.select("source", "target", "path")) == [("c", "c", ["c"]), ("e", "c", ["e", "c"])]


def test_events_without_time_come_last(spark):
    g = graph(spark, {"c": {}, "a": {"cls": "event", "ts": ""}, "b": {"cls": "event", "ts": "2020"}, "d": {"cls": "event", "ts": "2021"}}, [(x, "c", "assoc") for x in "abd"])
    assert [r.event_id for r in g.related_events().orderBy("nth").collect()] == ["d", "b", "a"]


def test_edge_rules(spark):
    g = graph(spark, {"a": {}, "f": {"cls": "fact"}, "h": {"cls": "fact"}}, [("a", "f", "assoc")])
    added = [("1", "a", "a", "assoc", 0.0), ("2", "a", "x", "assoc", 0.0), ("3", "a", "f", "mutex", 0.0), ("4", "a", "f", "odd", 0.0), ("5", "f", "h", "mutex", 0.0), ("6", "h", "f", "mutex", 0.0), ("7", "a", "f", "assoc", 1.0), ("8", "f", "a", "assoc", 0.0)]
    frame = spark.createDataFrame(added, EDGE).coalesce(1)
    faults = {r.id: r.fault for r in edge_faults(frame, g.nodes).collect()}
    assert faults == {"1": "self loop", "2": "missing end", "3": "mutex needs facts", "4": "unknown type", "5": None, "6": None, "7": None, "8": None}
    assert sorted(r.id for r in g.with_edges(frame).edges.collect()) == ["5", "8", "a>f:assoc"]
    with pytest.raises(ValueError):
        check_classes(g.nodes.withColumn("node_class", F.lit("odd")))


def test_subgraph_stops_at_the_first_overflow(spark):
    big = "x" * 600
    g = graph(spark, {"r": {}, "a": {}, "b": {"content": big}, "c": {}, "d": {}}, [("r", "a", "assoc"), ("r", "b", "assoc"), ("r", "c", "assoc"), ("a", "d", "assoc")])
    focus = spark.createDataFrame([("r",)], "me string")
    found = lambda budget_: [r.id for r in iterate.subgraphs(g, focus, budget_).orderBy("pos").collect()]
    assert found(None) == ["r"] and found(50) == ["r", "a"] and found(5000) == ["r", "a", "b", "c", "d"]


def test_next_fit_packing(spark):
    views = spark.createDataFrame([("k", i, t) for i, t in enumerate([4, 5, 3, 20, 1, 9])], "k string, pos int, tokens int")
    assert [r.batch for r in iterate.pack_layer(views, ["k"], 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]


def test_trim_always_keeps_the_first(spark):
    rows = spark.createDataFrame([("k", 1, 50), ("k", 2, 1), ("j", 1, 3), ("j", 2, 9), ("j", 3, 1)], "k string, pos int, cost int")
    assert pairs(budget.trim_prefix(rows, ["k"], "pos", "cost", 10).select("k", "pos")) == [("j", 1), ("k", 1)]


def test_window_split():
    assert budget.WindowSplit(10_000, 2000).task == 4000 and budget.WindowSplit(10_000, 2000, 1000).merge == 14_000


def test_recall(spark):
    g = graph(spark, {f"e{i}": {"cls": "event", "ts": f"2020-01-0{i}", "content": "y" * 30} for i in range(1, 6)}, [])
    take = lambda limit, tokens: [r.id for r in budget.recall_events(g.nodes, limit, tokens).orderBy("pos").collect()]
    assert take(2, 10_000) == ["e5", "e4"] and take(0, 100) == [] and take(5, 1) == ["e5"] and take(5, 60) == ["e5", "e4"]


def test_weak_components(spark):
    g = graph(spark, {c: {} for c in "abcdef"}, [("a", "b", "assoc"), ("c", "b", "assoc"), ("e", "d", "assoc")])
    assert pairs(iterate.weak_components(g)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")]


def test_exclusive_entries(spark):
    hits = [(1, "a", 5, False, 0), (1, "b", 9, True, 0), (1, "a", 9, True, 1), (1, "c", 20, False, 0), (2, "a", 5, False, 0)]
    merged = search.merge_entries(spark.createDataFrame(hits, "query_id int, id string, priority int, exclusive boolean, pos int"))
    assert pairs(merged.select("query_id", "place", "id")) == [(1, 1, "c"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a")]
    aliases = spark.createDataFrame([("x", "other name")], "id string, alias string")
    g = graph(spark, {"x": {"name": "own name"}}, [])
    assert pairs(search.postings(g.nodes, aliases)) == sorted(("x", t) for t in ("own name", "own", "name", "other name", "other"))


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcd")] + [(3, "a", 1)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id int, doc_id string")
    queries = spark.createDataFrame([(1, "t"), (2, "t"), (3, "null_query")], "query_id int, type string")
    row = rank.retrieval_metrics(ranked, gold, queries, (2, 4)).where("type = 't'").first()
    assert (row.n, row.hit_2, row.recall_4, row.mrr_4) == (2, 0.5, round(2 / 3 / 2, 6), 0.25)
    assert row.map_4 == round((0.5 + 2 / 4) / 3 / 2, 6) and row.map_2 == round(0.5 / 2 / 2, 6)
    assert rank.null_query_docs(ranked, queries).first().avg_docs == 1
    answers = spark.createDataFrame([(1, "3, 1, 3")], "query_id int, raw string")
    assert [r.doc_id for r in rank.choice_rerank(ranked.where("query_id = 1"), answers).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_counterfactual_and_reached(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcd")], "query_id int, doc_id string, rank int")
    queries = spark.createDataFrame([(1, "red fox")], "query_id int, query string")
    texts = spark.createDataFrame([("c", "fox", None), ("d", None, "a red fox"), ("x", "red fox", "red fox")], "doc_id string, title string, body string")
    found = rank.counterfactual_rerank(queries, ranked, texts).orderBy("new_rank").collect()
    assert [(r.doc_id, r.score) for r in found] == [("c", 1.5), ("d", 1.0), ("a", 0.0), ("b", 0.0)]
    gold = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, "a")], "query_id int, doc_id string")
    assert pairs(rank.reached(ranked, gold)) == [(1, 2, 1, True, 0.5), (2, 1, 0, False, 0.0)]
    assert rank.reached(ranked.limit(0), gold.limit(0)).count() == 0


def test_passages_of_any_length_are_found(spark):
    texts = ["one two three four five six", "xone two threex", "a onetwo b", "one", "", "one two three fourx", "two three"]
    passages = ["one two three four", "one two three", "two", "o", "one two", "one two three four five six", "none of it is there", "ee fo"]
    frame = lambda rows, names: spark.createDataFrame(list(enumerate(rows)), names)
    got = pairs(rank.passage_docs(frame(passages, "query_id int, passage string"), frame(texts, "doc_id int, text string")))
    assert got == sorted((i, j) for i, p in enumerate(passages) for j, t in enumerate(texts) if p in t)


def test_dedup_leaves_mutex_pairs(spark):
    g = graph(spark, {"a": {"name": "n", "cls": "fact", "content": "one"}, "b": {"name": "n", "cls": "fact", "content": "two"}, "c": {"name": "n", "cls": "fact", "content": "on"}, "e": {"cls": "event"}}, [("a", "b", "mutex"), ("e", "c", "assoc")])
    done = link.dedup(g)
    assert pairs(done.nodes.select("id", "content")) == [("a", "one"), ("b", "two"), ("e", "")]
    assert pairs(done.edges.select("source_id", "target_id")) == [("a", "b"), ("e", "a")]


def test_dedup_hangs_mutex_edges_to_the_survivor(spark):
    g = graph(spark, {c: {"name": "n", "cls": "fact", "content": c} for c in "abc"}, [("c", "b", "mutex")])
    done = link.dedup(g)
    assert pairs(done.nodes.select("id", "content")) == [("a", "a\nb"), ("c", "c")]
    assert pairs(done.edges.select("source_id", "target_id", "type")) == [("c", "a", "mutex")]


def test_dedup_within_the_budget(spark):
    long = {c: {"name": "n", "content": c * 60} for c in "abcd"}
    copies = {f"{c}{i}": {"name": "n", "content": c * 60} for c in "abd" for i in range(3)}
    g = graph(spark, long | copies | {"z": {"name": "other"}}, [])
    done = link.dedup(g, budget=50)
    # 27 tokens alone, 47 with b, too many with c; copies go the way of the first of their content
    assert pairs(done.nodes.select("id")) == [(i,) for i in ("a", "c", "d", "d0", "d1", "d2", "z")]
    assert done.nodes.where("id = 'a'").first().content == "a" * 60 + "\n" + "b" * 60
    none = link.dedup(g, budget=5)
    assert none.nodes.count() == 14


def test_absorption(spark):
    g = graph(spark, {"h": {"hub": True}, "x": {}, "m": {}, "n": {}, "o": {}}, [("h", "m", "assoc"), ("h", "n", "assoc"), ("x", "m", "assoc"), ("x", "n", "assoc"), ("x", "o", "assoc")])
    assert pairs(link.absorb(g).edges.select("source_id", "target_id")) == [("h", "m"), ("h", "n"), ("x", "h"), ("x", "o")]


def test_decisions(spark):
    g = graph(spark, {"k": {"name": "Known"}, "e": {"name": "event", "cls": "event"}}, [])
    rows = [(1, "create", " known ", None, None), (2, "create", "Fresh", None, None), (3, "create", "fresh", None, None), (4, "create", "event", None, None), (5, "merge", "m", None, None), (6, "merge", "m", "k", None)]
    frame = spark.createDataFrame(rows, "pos int, action string, name string, target_id string, node_class string")
    got = {r.pos: (r.action, r.target_id) for r in ingest.resolve_decisions(frame, g.nodes).collect()}
    assert got == {1: ("merge", "k"), 2: ("create", "new::2"), 3: ("merge", "new::2"), 4: ("create", "new::4"), 6: ("merge", "k")}
    with pytest.raises(Exception, match="unknown action"):
        ingest.sane_decisions(frame.withColumn("action", F.lit("odd"))).collect()


def test_merged_aliases(spark):
    lists = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, ingest.merged_aliases(lists("a"), lists("b", "", "n", "a"), F.lit("n"))) == ["a", "b"]


DECISION = "ingest_id string, pos int, action string, name string, content string, target_id string, node_class string, aliases array<string>, edges_to array<string>, edges_to_names array<string>, mutex_with array<string>, mutex_with_names array<string>"
INPUT = "ingest_id string, content string, ts string, doc_id string, chunk_id string"


def test_ingest_applies_decisions(spark):
    g = graph(spark, {"k": {"name": "Known", "content": "one"}, "f": {"name": "old fact", "cls": "fact"}}, [])
    inputs = spark.createDataFrame([("i", "text", "2020", "d", "1"), ("j", "other", "2021", None, None)], INPUT)
    rows = [
        ("i", 1, "create", " known ", "two", None, None, ["K2", "Known"], ["f"], ["Fresh"], None, None),
        ("i", 2, "create", "Fresh", None, None, None, None, None, None, None, None),
        ("i", 3, "create", "New fact", "says", None, "fact", None, None, None, ["f", "k"], ["Other fact", "Fresh"]),
        ("i", 4, "create", "Other fact", "denies", None, "fact", None, None, None, None, None),
        ("j", 5, "merge", "Alias", "three", "k", None, None, None, None, None, None),
        ("j", 6, "merge", "No target", "x", None, None, None, None, None, None, None),
        ("j", 7, "no_op", "Fresh", "x", None, None, None, None, None, None, None),
        ("gone", 8, "create", "Nobody", "x", None, None, None, None, None, None, None),
    ]
    drafts = spark.createDataFrame([("Fresh", 1, "first", "concept"), ("Fresh", 2, "last", "concept")], "name string, pos int, content string, node_class string")
    sources = spark.createDataFrame([("i", "paper", "whole", ["c1", "c2"]), ("j", "note", "whole", [])], "ingest_id string, name string, content string, chunks array<string>")
    done = ingest.apply(g, inputs, spark.createDataFrame(rows, DECISION), drafts, sources)
    nodes = {r.name: r for r in done.graph.nodes.collect()}
    assert len(nodes) == 2 + 3 + 2 + 2 and nodes["Known"].content == "one\ntwo\nthree" and nodes["Fresh"].content == "last"
    assert nodes["Known"].aliases == [" known ", "Alias", "K2"] and nodes["New fact"].node_class == "fact"
    assert [tuple(s)[:2] for s in nodes["Known"].sources] == [("d", "1")] and nodes["old fact"].sources is None
    by_id = {r.id: r.name for r in done.graph.nodes.collect()}
    edges = {(by_id[r.source_id], by_id[r.target_id], r.type) for r in done.graph.edges.collect()}
    own = {e for e in edges if e[0] not in ("text", "other", "paper", "note")}
    assert own == {("Known", "old fact", "assoc"), ("Known", "Fresh", "assoc"), ("New fact", "old fact", "mutex"), ("New fact", "Other fact", "mutex")}
    assert {e[:2] for e in edges if e[0] in ("other", "note")} == {("other", "Known"), ("note", "Known")}
    assert {e[1] for e in edges if e[0] == "paper"} == {"Known", "Fresh", "New fact", "Other fact"}
    # what was ingested before brings nothing, and an ingest that runs again no new nodes
    again = ingest.apply(done.graph, inputs, spark.createDataFrame(rows, DECISION), drafts, sources, done.done)
    assert again.graph.nodes.where("name = 'text'").count() == 1 and again.done.count() == 1
    assert again.graph.nodes.where("name = 'Known'").first().content == "one\ntwo\nthree"
    assert again.graph.nodes.count() == done.graph.nodes.count()


def test_repeated_names_of_any_class_give_one_node(spark):
    g = graph(spark, {"k": {"name": "Known"}}, [])
    rows = [("i", p, "create", "Talk", f"c{p}", None, "event", None, None, None, None, None) for p in (1, 2)]
    for n in ("i", "j"):
        inputs = spark.createDataFrame([(n, f"text {n}", "2020", None, None)], INPUT)
        g = ingest.apply(g, inputs, spark.createDataFrame([(n, *r[1:]) for r in rows], DECISION)).graph
    ids = [r.id for r in g.nodes.where("name = 'Talk'").collect()]
    assert len(ids) == len(set(ids)) == 2 and g.nodes.select("id").distinct().count() == g.nodes.count()


def test_documents_are_updated_and_purged(spark):
    engine = Engine(spark, graph(spark, {"k": {"name": "Known"}}, []), task_budget=1000)
    chunk = lambda *rows: spark.createDataFrame(rows, "chunk_id string, content string")
    decide = lambda *rows: spark.createDataFrame([(i, p, "create", n, n, None, None, None, None, None, None, None) for i, p, n in rows], DECISION)
    first = engine.update_document("d", chunk(("1", "a"), ("2", "b"), ("3", "c")), decide(("d/1", 1, "A"), ("d/2", 2, "B"), ("d/3", 3, "C"), ("d/3", 4, "Known")))
    sources = lambda e: {r.name: None if r.sources is None else [s.chunk_id for s in r.sources] for r in e.graph.nodes.where("node_class = 'concept'").collect()}
    assert sources(first) == {"Known": ["3"], "A": ["1"], "B": ["2"], "C": ["3"]}
    second = first.update_document("d", chunk(("1", "a"), ("2", "changed")), decide(("d/1", 1, "Z"), ("d/2", 2, "B2")))
    assert sources(second) == {"Known": [], "A": ["1"], "B": [], "C": [], "B2": ["2"]}
    assert pairs(second.done.select("chunk_id")) == [("1",), ("2",)]
    assert set(sources(second.purged())) == {"A", "B2"}


def test_root_summaries_and_links(spark):
    g = graph(spark, {"a": {"content": "One. Two."}, "b": {"content": "x"}, "c": {"hub": True}, "e": {"cls": "event"}}, [("a", "b", "assoc")])
    done = maintain.rooted(g)
    assert pairs(done.edges.where(f"source_id = '{ROOT}'").select("target_id")) == [("c",)] and maintain.rooted(done).nodes.count() == 5
    assert [r.id for r in maintain.top_seeds(done, 5).collect()] == ["c"] and [r.id for r in maintain.top_seeds(g, 5).collect()] == ["c"]
    assert maintain.graph_summary(done).first().value == "c"
    none = F.lit(None).cast("struct<text:string,length:int>")
    nodes = maintain.with_summaries(g.nodes.withColumn("summary", none), maintain.first_sentences)
    assert {r.id: r.summary and r.summary.text for r in nodes.collect()} == {"a": "One.", "b": "x", "c": None, "e": None}
    assert pairs(maintain.stale_summaries(nodes.withColumn("content", F.when(F.col("id") == "a", "longer now").otherwise(F.col("content")))).select("id")) == [("a",), ("c",), ("e",)]
    links = spark.createDataFrame([("a", "c", 0.9), ("b", "a", 1.0), ("c", "b", 0.5)], "source_id string, target_id string, confidence double")
    assert pairs(maintain.with_links(g, links).edges.select("id")) == [("a>b:assoc",), ("a>c:assoc",)]


def chosen_by_id(candidates):
    """Choices that depend on nothing but the candidate, and answers that can't be read for batches of three views."""
    code = F.crc32(F.col("id"))
    return candidates.withColumns({"result": code % 3 == 0, "expand": code % 2 == 0})


def walked(nodes, edges, seeds, budget_, rounds, most_frontier, most_nodes):
    """The traversal of one query, step by step."""
    known = {i: k for k, i in enumerate(nodes)}
    core = lambda i: nodes[i].get("cls", "concept") in ("concept", "fact")
    name, content = lambda i: nodes[i].get("name", i), {i: n.get("content", "") for i, n in nodes.items()}
    sees = {i: [] for i in nodes}
    for a, b, t in sorted(edges, key=lambda e: f"{e[0]}>{e[1]}:{e[2]}"):
        for me, other in {(a, b), (b, a)}:
            if me in nodes and not (core(me) and t == "assoc" and nodes[other].get("cls") == "event"):
                sees[me].append((f"{a}>{b}:{t}", other))
    down = {i: {b for a, b, t in edges if a == i and t == "assoc"} for i in nodes}
    cost = lambda i, c: tx.estimate_text(tx.rendered_node(i, name(i), c))
    frontier, visited, held, order, picked = list(dict.fromkeys(seeds)), set(), {}, [], []
    used, names = 0, {}
    ends = {f"{a}>{b}:{t}": (a, b) for a, b, t in edges}
    for _ in range(rounds):
        if not frontier or len(held) >= most_nodes or used >= budget_:
            break
        views = []
        for i in frontier:
            around = sorted({o for _, o in sees[i]} | down[i] - {i}, key=lambda o: (known[o], o))
            links = sorted({e for e, _ in sees[i]})
            if not around and i in visited:
                continue
            lines = [tx.rendered_node(x, name(x), nodes[x].get("content", ""))[1:] for x in [i, *around]] + [f" {name(ends[e][0])} — {name(ends[e][1])}" for e in links]
            views.append(([i, *around], links, tx.estimate_text("\n".join(f"{k}.{line}" for k, line in enumerate(lines, 1)))))
        if not views:
            break
        room, batches, load = budget_ - used, [], 0
        for v in views:
            if not batches or load + v[2] > room:
                batches.append([])
                load = 0
            batches[-1].append(v)
            load += v[2]
        frontier, stop = [], False
        for batch in batches:
            if len(held) >= most_nodes or used >= budget_:
                stop = True
                break
            shown = list(dict.fromkeys(x for v in batch for x in v[0])) + list(dict.fromkeys(e for v in batch for e in v[1]))
            code = {x: zlib.crc32(x.encode()) for x in shown}
            for x in sorted(shown, key=lambda x: (code[x] % 3 != 0, shown.index(x))):
                result, expand = code[x] % 3 == 0, code[x] % 2 == 0
                if not (result or expand) or stop:
                    continue
                if x in ends and result and x not in picked:
                    picked.append(x)
                for i in ends.get(x, (x,)):
                    if i in visited or stop:
                        continue
                    visited.add(i)
                    if result:
                        first = names.get(name(i))
                        if first is not None and nodes[i].get("content", "") not in ("",):
                            own, new = content[first], nodes[i]["content"]
                            merged = own if new in own else f"{own}\n{new}"
                        elif first is not None:
                            merged = content[first]
                        if first is not None and used + cost(first, merged) - cost(first, content[first]) <= budget_:
                            used += cost(first, merged) - cost(first, content[first])
                            content[first] = merged
                            continue
                        names.setdefault(name(i), i)
                        held[i] = True
                        order.append(i)
                        used += cost(i, nodes[i].get("content", ""))
                        stop = len(held) >= most_nodes
                    if expand and len(frontier) < most_frontier:
                        frontier.append(i)
        if stop:
            break
    return [(i, content[i]) for i in order], sorted(picked)


@pytest.mark.parametrize("seed", range(4))
def test_traversal_against_a_walk_step_by_step(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i}": {"name": rng.choice(["same", "twin", f"name {i}", f"word {i}"]), "content": rng.choice(["", "text", "longer text " * rng.randrange(1, 9)]), "cls": rng.choice(["concept", "fact", "fact", "event"])} for i in range(40)}
    ids = list(nodes)
    drawn = {(rng.choice(ids), rng.choice(ids)) for _ in range(60)}
    edges = [(a, b, rng.choice(["assoc", "assoc", "mutex"]) if nodes[a]["cls"] == nodes[b]["cls"] == "fact" else "assoc") for a, b in drawn if a != b]
    g = graph(spark, nodes, edges)
    limits = {q: rng.choices(ids, k=3) for q in range(3)}
    for budget_, frontier, most in ((120, 4, 9), (100_000, 500, 1000)):
        rows = [(q, "", s, k) for q, seeds in limits.items() for k, s in enumerate(seeds)]
        found = iterate.traverse(g, spark.createDataFrame(rows, "query_id int, query string, id string, place int"), chosen_by_id, budget_, 4, frontier, most)
        got, linked = {q: [] for q in limits}, {q: [] for q in limits}
        for r in sorted(found.nodes.collect(), key=lambda r: (r.query_id, r.place)):
            got[r.query_id].append((r.id, r.content))
        for r in found.edges.collect():
            linked[r.query_id].append(r.edge_id)
        for q, seeds in limits.items():
            assert (got[q], sorted(linked[q])) == walked(nodes, edges, seeds, budget_, 4, frontier, most)


def test_answers_that_cannot_be_read_are_asked_again_by_view(spark):
    g = graph(spark, {c: {} for c in "abcd"}, [("a", "b", "assoc"), ("c", "d", "assoc")])
    seeds = spark.createDataFrame([(1, "", "a"), (1, "", "c")], "query_id int, query string, id string")

    def unreadable(candidates):
        lost = F.count("*").over(Window.partitionBy("query_id", "batch", *(["at"] if asked else []))) > 3
        asked.append(1)
        return candidates.withColumns({"result": F.when(~lost, F.col("kind") == "node"), "expand": F.when(~lost, F.lit(False))})

    asked = []
    assert {r.id for r in iterate.traverse(g, seeds, unreadable, most_rounds=1).nodes.collect()} == set("abcd") and len(asked) == 2


def test_compaction_bounds_a_neighbourhood(spark):
    nodes = {"c": {}} | {f"m{i}": {"content": ("red thing " if i % 2 else "blue thing ") + "z" * 20} for i in range(12)}
    g = graph(spark, nodes, [("c", f"m{i}", "assoc") for i in range(12)])
    before = budget.neighbourhood_costs(g).where("id = 'c'").first().tokens
    done = compact.compact(g, 100)
    after = {r.id: r.tokens for r in budget.neighbourhood_costs(done).collect()}
    assert before > 100 > after["c"]
    assert done.nodes.where("hub").count() == 2 and done.edges.count() == 14


def test_parsers():
    assert parse.strip_fence("```json\n[1]\n```") == "[1]" and parse.strip_thinking("<think>x</think> y") == "y"
    assert parse.load('text {"a": "}"} more') == {"a": "}"} and parse.load('[{"a": 1}, {"b": "cut') == [{"a": 1}, {"b": "cut"}]
    assert parse.leading_items('[1, {"a": 2}, {"b"') == [1, {"a": 2}] and parse.load("none here") is None
    assert parse.concepts('{"concepts": [{"title": "T", "node_class": "odd"}, "S", {"x": 1}]}') == [
        {"name": "T", "content": "T", "node_class": "concept", "relation_hints": []}, {"name": "S", "content": "S", "node_class": "concept", "relation_hints": []}
    ]
    one = parse.decisions('[{"action": "odd", "concept": {"name": "n"}, "edges_to": ["a", {"target_id": "b"}, 3]}]')[0]
    assert (one["action"], one["name"], one["edges_to"]) == ("no_op", "n", ["a", "b"])
    assert parse.ids('ids: ["id=a", "b"') == ["a", "b"] and parse.ids('{"ids": [{"id": "c"}]}') == ["c"] and parse.ids("") == []
    assert parse.selection("[2, true, 3]") == {"result": [2, 3], "frontier": [2, 3]} and parse.selection('{"result": [1]}') == {"result": [1], "frontier": []}
    assert parse.communities('{"communities": [{"theme": "t", "members": ["a"], "strategy": "odd"}]}')[0]["strategy"] == "summarize"
    assert parse.source_of("Source(doc_id='d', chunk_id='1')")["doc_id"] == "d" and parse.source_of('{"doc_id": "x"}')["doc_id"] == "x"
    assert parse.fill("{a} {b}", {"a": "1"}) == "{a} {b}" and parse.fill("{a}", {"a": "1"}) == "1"
    assert parse.expand_variables({"k": ["${A}", "${B:-b}", "${C}", 1]}, {"A": "a"}) == {"k": ["a", "b", "${C}", 1]}


def test_parsed_columns(spark):
    rows = spark.createDataFrame([('[{"name": "n"}]',), (None,), ("[[",)], "raw string")
    assert [len(r.c) for r in rows.select(parse.parsed(parse.concepts, F.col("raw")).alias("c")).collect()] == [1, 0, 0]


def test_store_round_trip(spark, tmp_path):
    g = graph(spark, {"a": {}, "b": {"cls": "fact"}}, [("a", "b", "assoc"), ("a", "x", "assoc")])
    store.save(g, str(tmp_path), {"alias_index": "1"})
    back = store.without_dangling(store.load(spark, str(tmp_path)))
    assert pairs(back.nodes.select(store.NODE_COLUMNS)) == pairs(g.nodes) and back.edges.count() == 1
    meta = store.meta(spark, str(tmp_path))
    assert store.provenance_warnings(meta, {"alias_index": "1"}) == [] and len(store.provenance_warnings(meta, {"alias_index": "2"})) == 1
    store.set_meta(spark, str(tmp_path), spark.createDataFrame([("graph_summary", "s")], "key string, value string"))
    assert store.meta(spark, str(tmp_path)).count() == 3


def test_saving_to_the_folder_loaded_from(spark, tmp_path):
    g = graph(spark, {"a": {}, "b": {}}, [("a", "b", "assoc")])
    for n in range(4):
        assert store.save(g, str(tmp_path)) == n
        g = store.load(spark, str(tmp_path))
        more = graph(spark, {f"new{n}": {}}, [])
        g = Graph(g.nodes.unionByName(more.nodes), g.edges)
    assert store.save(g, str(tmp_path)) == 4 and store.load(spark, str(tmp_path)).nodes.count() == 6
    # a version that isn't finished isn't read
    (tmp_path / "v=9" / "nodes").mkdir(parents=True)
    assert store.load(spark, str(tmp_path)).edges.count() == 1
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_extension_bags(spark):
    rows = spark.createDataFrame([("a", ["x"], None), ("b", None, "s")], "id string, aliases array<string>, summary string")
    bags = rows.select("id", store.encoded_extensions({"alias_index": F.struct("aliases"), "summary": F.col("summary")}).alias("bag"))
    slots = {"alias_index": "struct<aliases:array<string>>", "summary": "string"}
    back = bags.select("id", *(c.alias(n) for n, c in store.decoded_extensions(F.col("bag"), slots).items())).select("id", "alias_index.aliases", "summary")
    assert pairs(back) == [("a", ["x"], None), ("b", None, "s")]
    odd = spark.createDataFrame([("not json",), ('{"source_tracking": {"sources": [{"doc_id": "d"}]}}',)], "bag string")
    read = lambda path: [r.v for r in odd.select(store.extension_path(store.read_extensions(F.col("bag")), path).alias("v")).collect()]
    assert read("$.source_tracking.sources[0].doc_id") == [None, "d"] and read("$.none") == [None, None]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": t, "body": "b"} for t in "abc"]))
    asked = [{"query": "q1", "evidence_list": [{"title": "a"}]}, {"query": "q2", "evidence_list": [{"title": "a"}, {"title": "zz"}]}]
    (tmp_path / "q.json").write_text(json.dumps(asked))
    docs, questions = store.read_benchmark(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"), 3)
    assert docs.count() == 3 and [r.query for r in questions.collect()] == ["q1"]
    (tmp_path / "l.jsonl").write_text('{"query_id": "1"}\nnot json\n')
    done = store.read_json_lines(spark, str(tmp_path / "l.jsonl"), "query_id string")
    assert [r.query_id for r in store.unfinished(spark.createDataFrame([("1",), ("2",)], "query_id string"), done).collect()] == ["2"]


def test_flushed_logs(spark):
    g = graph(spark, {"a": {}, "b": {}, "c": {}}, [("a", "b", "assoc"), ("b", "c", "assoc")])
    log = lambda df, op, seq: df.select("id", F.lit(op).alias("op"), F.struct(*df.columns).alias("value"), F.lit(seq).alias("seq"))
    node_log = log(g.nodes.where("id = 'c'"), "delete", 2).unionByName(log(g.nodes.where("id = 'a'").withColumn("name", F.lit("A")), "upsert", 1))
    done = store.flushed(g, node_log, log(g.edges.limit(0), "delete", 1))
    assert pairs(done.nodes.select("id", "name")) == [("a", "A"), ("b", "b")] and done.edges.count() == 1


def test_streams(spark, tmp_path):
    chunks = "doc_id string, chunk_id string, content string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("d", "1", "x"), ("d", "1", "x"), ("d", "2", "y")], [("d", "1", "x"), ("d", "2", "changed")]):
        spark.createDataFrame(batch, chunks).coalesce(1).write.mode("append").parquet(source)
        ingest_once(spark, spark.readStream.schema(chunks).parquet(source), out, str(tmp_path / "check")).awaitTermination()
    assert pairs(spark.read.parquet(f"{out}/chunks").select("chunk_id", "content")) == [("1", "x"), ("2", "changed"), ("2", "y")]

    kept = "target_id string, event_id string, event_ts string"
    for batch in ([("n", "a", "1"), ("n", "b", "3")], [("n", "c", "2"), ("m", "d", "1")]):
        spark.createDataFrame(batch, kept).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        newest_events(spark, spark.readStream.schema(kept).parquet(str(tmp_path / "events")), str(tmp_path / "top"), str(tmp_path / "check2"), 2).awaitTermination()
    assert pairs(newest_of(spark, str(tmp_path / "top")).drop("nth")) == [("m", "d", "1"), ("n", "b", "3"), ("n", "c", "2")]

    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(raw.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < spark.table("hours").agg(F.sum("n")).first()[0] <= raw.count()
    assert timeline(spark.createDataFrame([("i", "text", "t")], "ingest_id string, content string, ts string")).first().name == "text"


def test_registry():
    r = Registry()
    r.register("trim", "a", print, 1)
    r.register("trim", "b", len, 5)
    r.register("arbitrate", "a", print)
    assert r.all("trim") == [len, print] and r.get("trim", "x") is None
    for point, name in (("trim", "a"), ("arbitrate", "b")):
        with pytest.raises(ValueError):
            r.register(point, name, print)


def test_engine(spark, tmp_path):
    g = graph(spark, {"r": {"name": "root", "hub": True}, "a": {"name": "graph memory"}, "b": {"name": "other", "content": "memory of graphs"}}, [("r", "a", "assoc"), ("a", "b", "assoc")])
    engine = Engine(spark, g, task_budget=1000)
    asked = spark.createDataFrame([(1, "graph memory"), (2, "nothing")], "query_id int, query string")
    assert {r.id for r in engine.locate(asked).where("query_id = 1").collect()} == {"a", "r"}
    found = engine.query(asked)
    assert {(r.query_id, r.id) for r in found.nodes.collect()} == {(1, "a"), (1, "b"), (1, "r")}
    assert pairs(found.edges) == [(1, "a>b:assoc"), (1, "r>a:assoc")] and pairs(found.focus) == [(1, "a")]
    assert {r.id for r in engine.query_nodes(asked).collect()} == {"a", "b", "r"}
    assert {r.id for r in engine.associate("r", 2).collect()} == {"a", "b", "r"}
    inputs = spark.createDataFrame([("i1", "saw other things", "2020")], "ingest_id string, content string, ts string")
    choices = [("i1", 1, "create", "Other", "new words", None, None), ("i1", 2, "create", "brand new", "body", None, "fact")]
    decided = spark.createDataFrame(choices, "ingest_id string, pos int, action string, name string, content string, target_id string, node_class string")
    grown = engine.ingest(inputs, decided)
    nodes = {r.name: r for r in grown.graph.nodes.collect()}
    assert nodes["other"].content == "memory of graphs\nnew words" and nodes["brand new"].node_class == "fact" and len(nodes) == 5
    assert {r.node_id for r in grown.graph.related_events().collect()} == {"b", nodes["brand new"].id}
    grown.registry.register("maintenance", "bad", lambda graph: 1 / 0)
    kept, failed = grown.maintained()
    assert len(failed) == 1 and failed[0].startswith("bad: division by zero") and kept.report().first().nodes == 6
    kept.save(str(tmp_path))
    assert Engine.from_folder(spark, str(tmp_path)).graph.nodes.count() == 6
    assert grown.recall().count() == 1 and kept.find_path("r", "b").first().path == ["r", "a", "b"]


def test_short_rendering_queries_cut_long_contents(spark):
    from loamgraph.plans.queries import QUERIES

    lines = {name: {r.id: r.line for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()} for name in ("render_node", "render_node_short")}
    assert lines["render_node"].keys() == lines["render_node_short"].keys()
    assert all(line.startswith(lines["render_node_short"][i]) for i, line in lines["render_node"].items())
    assert any(len(line) > len(lines["render_node_short"][i]) for i, line in lines["render_node"].items())
