"""What loops leave on disk: neither shuffle files nor the rounds before the last one."""

import os

from loamgraph.operators import ingest
from loamgraph.operators.compact import compact
from loamgraph.operators.components import connected_components
from loamgraph.operators.graph import Graph
from loamgraph.operators.shared import cut, forget, shared_folder


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def checkpoints(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {d for d in os.listdir(folder) if any(f.startswith("part-") and os.path.getsize(f"{folder}/{d}/{f}") for f in os.listdir(f"{folder}/{d}"))}


def test_cut_frees_its_shuffles_and_forget_its_files(spark):
    files, kept = shuffle_files(spark), checkpoints(spark)
    made = cut(spark.range(1000).selectExpr("id % 7 as k").repartition("k").groupBy("k").count())
    assert shuffle_files(spark) <= files
    assert made.count() == 7 and checkpoints(spark) > kept
    forget(made, made.where("k > 1"))
    assert checkpoints(spark) == kept


def test_components_keep_their_last_round_only(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    kept = checkpoints(spark)
    got = connected_components(links, "a", "b")
    assert len(checkpoints(spark) - kept) == 1
    assert {r.component for r in got.collect()} == {0} and got.count() == 201


def test_ingest_deletes_the_nodes_it_passes_through(spark):
    nodes = spark.createDataFrame([("a", "A", "x", "concept", False, None, None, 0)], "id string, name string, content string, node_class string, hub boolean, doc_id string, event_ts string, seq long")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, type string, priority double")
    inputs = spark.createDataFrame([("i", "text", "2026")], "ingest_id string, content string, ts string")
    decisions = spark.createDataFrame([("i", 0, "merge", "A", "more", "a", None), ("i", 1, "create", "B", "y", None, None)], "ingest_id string, pos int, action string, name string, content string, target_id string, node_class string")
    kept = checkpoints(spark)
    done = ingest.apply(Graph(nodes, edges), inputs, decisions)
    assert len(checkpoints(spark) - kept) == 6  # inputs, decisions twice, what changed, nodes and edges
    assert {(r.name, r.content) for r in done.graph.nodes.where("node_class = 'concept'").collect()} == {("A", "x\nmore"), ("B", "y")}
    assert done.new_nodes.count() == 3 and done.new_edges.count() == 2


def test_compaction_leaves_no_shuffle_files(spark):
    rows = [("h", "h", "", "concept", True, 0)] + [(f"m{i}", f"m{i}", f"{'red' if i % 2 else 'blue'} thing {i}", "concept", False, i + 1) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id string, name string, content string, node_class string, hub boolean, seq long").repartition(3)
    edges = spark.createDataFrame([(f"h>m{i}:assoc", "h", f"m{i}", "assoc", 0.0) for i in range(40)], "id string, source_id string, target_id string, type string, priority double")
    files = shuffle_files(spark)
    got = compact(Graph(cut(nodes), cut(edges)), 100)
    left = shuffle_files(spark) - files
    assert got.nodes.count() > 41 and not left
