"""Upkeep of a graph: the root and what hangs below it, summaries, and linked documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators.graph import ROOT, Graph, is_core, shaped
from loamgraph.operators.ingest import roots_to_hang
from loamgraph.operators.link import links_to_apply

#: Nodes (id, name, content) to texts (id, text); null texts are passed over.
Writer = Callable[[DataFrame], DataFrame]


def top_seeds(graph: Graph, most: int) -> DataFrame:
    """(id, seq) of what is right below the root, or of hubs where there is no root, the first ``most``."""
    below = graph.edges.where((F.col("source_id") == ROOT) & (F.col("type") == "assoc")).select(F.col("target_id").alias("id"))
    rooted = graph.nodes.where(F.col("id") == ROOT).limit(1).count() > 0
    found = graph.nodes.join(below.distinct(), "id", "left_semi") if rooted else graph.hubs()
    return found.select("id", "seq").orderBy("seq", "id").limit(most)


def rooted(graph: Graph, changed: DataFrame | None = None) -> Graph:
    """The graph with a root, and with the changed core nodes (id), or all, that see nothing hung below it."""
    values = {"id": ROOT, "name": ROOT, "content": "", "node_class": "concept", "hub": True, "seq": -1}
    schema = graph.nodes.select(*values).schema
    made = graph.nodes.sparkSession.createDataFrame([tuple(values.values())], schema)
    nodes = graph.nodes.unionByName(shaped(made.join(graph.nodes.select("id"), "id", "left_anti"), graph.nodes))
    loose = roots_to_hang(graph, changed).where(F.col("id") != ROOT)
    hung = loose.select(F.concat(F.lit(f"{ROOT}>"), "id", F.lit(":assoc")).alias("id"), F.lit(ROOT).alias("source_id"), F.col("id").alias("target_id"), F.lit("assoc").alias("type"), F.lit(0.0).alias("priority"))
    return Graph(nodes, graph.edges.unionByName(shaped(hung, graph.edges)))


def stale_summaries(nodes: DataFrame) -> DataFrame:
    """Nodes (id, content, summary struct of text and length, ...) whose summary is missing or was made of a content of
    another length."""
    length = F.length(F.coalesce("content", F.lit("")))
    missing = F.coalesce(F.col("summary.text"), F.lit("")) == ""
    return nodes.where(missing | ~F.col("summary.length").eqNullSafe(length))


def with_summaries(nodes: DataFrame, write: Writer) -> DataFrame:
    """``nodes`` with the summaries that ``write`` gives for the stale ones; where it gives none the old one stays."""
    texts = write(stale_summaries(nodes).select("id", "name", "content")).select("id", F.col("text").alias("_text"))
    fresh = F.struct(F.col("_text").alias("text"), F.length(F.coalesce("content", F.lit(""))).alias("length"))
    joined = nodes.join(texts, "id", "left")
    return joined.withColumn("summary", F.when(F.coalesce("_text", F.lit("")) != "", fresh).otherwise(F.col("summary"))).select(nodes.columns)


def first_sentences(nodes: DataFrame) -> DataFrame:
    """A stand-in for a language model: the first sentence, cut to 200 characters."""
    return nodes.select("id", tx.cut_text(F.split("content", r"(?<=[.!?。！？])\s")[0], 200).alias("text"))


def graph_summary(graph: Graph, most: int = 10) -> DataFrame:
    """A row for meta, (key, value): the names of what is right below the root, in order."""
    top = graph.nodes.join(top_seeds(graph, most).select("id"), "id", "left_semi")
    named = F.array_sort(F.collect_list(F.struct("seq", "id", "name")))  # a handful by the limit
    return top.agg(F.array_join(F.transform(named, lambda x: x["name"]), ", ").alias("value")).select(F.lit("graph_summary").alias("key"), "value")


def with_links(graph: Graph, candidates: DataFrame, least: float = 0.8) -> Graph:
    """The graph with candidates that ``links_to_apply`` takes as assoc edges; ids that are known already stay as they are."""
    chosen = links_to_apply(graph, candidates, least)
    edges = chosen.select(F.concat("source_id", F.lit(">"), "target_id", F.lit(":assoc")).alias("id"), "source_id", "target_id", F.lit("assoc").alias("type"), F.lit(0.0).alias("priority"))
    fresh = edges.join(graph.edges.select("id"), "id", "left_anti")
    return Graph(graph.nodes, graph.edges.unionByName(shaped(fresh, graph.edges)))
