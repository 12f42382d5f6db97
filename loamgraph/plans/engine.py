"""The facade: a graph with its queries, writes and maintenance, and what is plugged into them."""

from __future__ import annotations

import traceback
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import budget, compact, descend, ingest, iterate, link, maintain, quality, search
from loamgraph.operators.graph import Graph
from loamgraph.sources import changes, store, term_index

#: Points at which functions are plugged in, all from DataFrames to a DataFrame, but for "maintenance"
#: and "compaction", which take and give a Graph, and "index", whose members have lookup(queries) and
#: updated(changed, gone), as TermIndex has, and are told of every write.
POINTS = ["entry", "trim", "arbitrate", "postprocess", "write_preprocess", "query_preprocess", "compaction", "maintenance", "index"]
ALONE = {"arbitrate"}


@dataclass
class Registry:
    """Named functions per point, by falling priority."""

    known: dict[str, dict[str, tuple[int, Callable]]] = field(default_factory=lambda: {p: {} for p in POINTS})

    def register(self, point: str, name: str, function: Callable, priority: int = 0) -> None:
        if name in self.known[point]:
            raise ValueError(f"{point} {name} is registered already")
        if point in ALONE and self.known[point]:
            raise ValueError(f"there is one {point} at most")
        self.known[point][name] = (priority, function)

    def unregister(self, point: str, name: str) -> None:
        self.known[point].pop(name, None)

    def get(self, point: str, name: str) -> Callable | None:
        return self.known[point].get(name, (0, None))[1]

    def all(self, point: str) -> list[Callable]:
        return [f for _, f in sorted(self.known[point].values(), key=lambda x: -x[0])]


@dataclass(frozen=True)
class Subgraph:
    """Results of queries: nodes (query_id, round, place, id, content), edges (query_id, edge_id) between known nodes, and
    focus (query_id, id), each query's first node."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def focus(self) -> DataFrame:
        return self.nodes.groupBy("query_id").agg(F.min_by("id", F.struct("round", "place")).alias("id"))


@dataclass
class Engine:
    """Queries run for many texts at once: a DataFrame (query_id, query) in, rows per query out."""

    spark: SparkSession
    graph: Graph
    task_budget: int = 16_000
    selector: iterate.Selector = iterate.lexical_selector
    decider: compact.Decider = compact.by_first_word
    chooser: descend.Chooser | None = None  #: goes down from the root level by level; none takes what is right below it
    registry: Registry = field(default_factory=Registry)
    done: DataFrame | None = None  #: chunks ingested before: doc_id, chunk_id, content_hash

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **settings) -> Engine:
        for warning in store.provenance_warnings(store.meta(spark, folder), {}):
            warnings.warn(warning, stacklevel=2)
        return cls(spark, store.without_dangling(changes.load(spark, folder)), done=changes.done(spark, folder), **settings)

    def aliases(self) -> DataFrame | None:
        if "aliases" not in self.graph.nodes.columns:
            return None
        return self.graph.nodes.select("id", F.explode("aliases").alias("alias"))

    def _fallback(self, queries: DataFrame) -> DataFrame:
        """Entries below all others: where ``chooser`` lands from the root, or what is right below it."""
        if self.chooser is not None:
            landed = descend.descend(self.graph, queries, self.chooser)
            return landed.select("query_id", "id", F.lit(0).alias("priority"), F.lit(False).alias("exclusive"), (F.col("level") * 1000 + F.col("place")).cast("long").alias("pos"))
        top = [(r.id, r.seq) for r in maintain.top_seeds(self.graph, 10).collect()]
        seeds = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).cast("long").alias("pos")) for i, n in top)) if top else F.array().cast("array<struct<id:string,pos:bigint>>")
        return queries.select("query_id", F.inline(seeds)).select("query_id", "id", F.lit(0).alias("priority"), F.lit(False).alias("exclusive"), "pos")

    def locate(self, queries: DataFrame) -> DataFrame:
        """Seeds (query_id, query, id, place): names and aliases that share a token, looked up in the registered indexes or, where
        there are none, in postings of the whole graph, then what is below the root or, where
        there is no root, hubs; trimmed to the budget."""
        for f in self.registry.all("query_preprocess"):
            queries = f(queries)
        hits = [index.lookup(queries) for index in self.registry.all("index")]
        hits = reduce(DataFrame.unionByName, hits) if hits else search.lookup(queries, search.postings(self.graph.nodes, self.aliases()))
        named = hits.select("query_id", "id", F.lit(100).alias("priority"), F.lit(False).alias("exclusive"), "pos")
        entries = named.unionByName(self._fallback(queries))
        for f in self.registry.all("entry"):
            entries = entries.unionByName(f(queries))
        merged = search.merge_entries(entries).join(budget.node_costs(self.graph.nodes), "id")
        for f in self.registry.all("trim"):
            merged = f(merged)
        kept = budget.trim_prefix(merged, ["query_id"], "place", "tokens", self.task_budget)
        return kept.join(queries, "query_id").select("query_id", "query", "id", "place")

    def query(self, queries: DataFrame, context: DataFrame | None = None, rounds: int = 5) -> Subgraph:
        """What a walk from the located seeds, or from ``context`` (query_id, id), gathers, after what is registered to
        change it, in the order of priorities; that gets and gives nodes (query_id, round, place, id, content)."""
        seeds = self.locate(queries) if context is None else context.join(queries, "query_id")
        found = iterate.traverse(self.graph, seeds, self.selector, self.task_budget, rounds)
        nodes = found.nodes
        for point in ("arbitrate", "postprocess"):
            for f in self.registry.all(point):
                nodes = f(nodes)
                if missing := {"query_id", "id"} - set(nodes.columns):
                    raise ValueError(f"{point}: no column {', '.join(sorted(missing))}")
        ends = self.graph.edges.select(F.col("id").alias("edge_id"), "source_id", "target_id").join(found.edges, "edge_id")
        ids = nodes.select("query_id", "id").distinct()
        kept = ends.join(ids.withColumnRenamed("id", "source_id"), ["query_id", "source_id"], "left_semi").join(ids.withColumnRenamed("id", "target_id"), ["query_id", "target_id"], "left_semi")
        return Subgraph(nodes, kept.select("query_id", "edge_id"))

    def query_nodes(self, queries: DataFrame) -> DataFrame:
        """The light query: one round, nothing that changes results, nodes only."""
        return iterate.traverse(self.graph, self.locate(queries), self.selector, self.task_budget, 1).nodes

    def associate(self, node_id: str, rounds: int = 5) -> DataFrame:
        seed = self.spark.createDataFrame([("associate", "", node_id)], "query_id string, query string, id string")
        every = lambda c: c.withColumns({"result": F.lit(True), "expand": F.lit(True)})
        return iterate.traverse(self.graph, seed, every, self.task_budget, rounds).nodes

    def recall(self, limit: int = 5) -> DataFrame:
        return budget.recall_events(self.graph.of_class("event"), limit, self.task_budget)

    def find_path(self, source: str, target: str, most_hops: int = 6) -> DataFrame:
        pair = self.spark.createDataFrame([(source, target)], "source string, target string")
        return iterate.shortest_paths(self.graph, pair, most_hops)

    def view(self, node_id: str) -> tuple[DataFrame, DataFrame]:
        return self.graph.view(self.spark.createDataFrame([(node_id,)], "me string"))

    def ingest(self, inputs: DataFrame, decisions: DataFrame, drafts: DataFrame | None = None, sources: DataFrame | None = None) -> Engine:
        """The engine after ``ingest.apply``: inputs (ingest_id, content, ts, and maybe doc_id, chunk_id), whose chunks are
        passed over where they were ingested before, decisions about them, drafts (name, pos, content, node_class) and
        sources (ingest_id, name, content, chunks). Neighbourhoods that outgrow the budget are split."""
        for f in self.registry.all("write_preprocess"):
            inputs = f(inputs)
        applied = ingest.apply(self.graph, inputs, decisions, drafts, sources, self.done)
        touched = applied.new_nodes.select("id")
        return replace(self, graph=applied.graph, done=iterate.cut(applied.done))._noted(self.graph).compacted(touched)

    def update_document(self, doc_id: str, chunks: DataFrame, decisions: DataFrame, drafts: DataFrame | None = None) -> Engine:
        """Ingest what is new or changed of a document's ``chunks`` (chunk_id, content), and let nodes forget the chunks
        that it no longer has; ``decisions`` name inputs as ``<doc_id>/<chunk_id>``. Nothing is deleted: see ``purged``."""
        name = F.concat(F.lit(f"{doc_id}/"), "chunk_id")
        chunks = chunks.select("chunk_id", "content")
        inputs = chunks.select(name.alias("ingest_id"), "content", F.lit(None).cast("string").alias("ts"), F.lit(doc_id).alias("doc_id"), "chunk_id")
        grown = self.ingest(inputs, decisions, drafts)
        nodes = ingest.pruned_sources(ingest.with_optional(grown.graph.nodes), doc_id, ingest.chunk_keys(chunks))
        done = grown.done.join(chunks.select(F.lit(doc_id).alias("doc_id"), "chunk_id", F.lit(True).alias("_here")), ["doc_id", "chunk_id"], "left")
        kept = done.where((F.col("doc_id") != doc_id) | F.col("_here")).drop("_here")
        return replace(grown, graph=Graph(iterate.cut(nodes), grown.graph.edges), done=iterate.cut(kept.select("doc_id", "chunk_id", "content_hash")))

    def purged(self) -> Engine:
        """Without nodes that had sources and have none left, and without their edges."""
        left = self.graph.without_nodes(ingest.orphans(ingest.with_optional(self.graph.nodes)).select("id"))
        return replace(self, graph=left)._noted(self.graph)

    def compacted(self, changed: DataFrame | None = None) -> Engine:
        """With neighbourhoods beyond the budget split: all, or those that ``changed`` nodes (id) are in."""
        graph = compact.compact(self.graph, self.task_budget, self.decider, changed=changed)
        for f in self.registry.all("compaction"):
            graph = f(graph)
        return replace(self, graph=graph)._noted(self.graph)

    def _noted(self, before: Graph) -> Engine:
        """With registered indexes that know what is called otherwise, new or gone since ``before``; those of the engine
        before stay as they are."""
        indexes = self.registry.known["index"]
        if not indexes:
            return self
        changed, gone = map(iterate.cut, term_index.differences(before.nodes, self.graph.nodes))
        if changed.isEmpty() and gone.isEmpty():
            return self
        told = {name: (priority, index.updated(changed, gone)) for name, (priority, index) in indexes.items()}
        return replace(self, registry=Registry({**self.registry.known, "index": told}))

    def maintained(self) -> tuple[Engine, list[str]]:
        """After deduplication, absorption by hubs, upkeep of the root and registered jobs. A registered job that fails is
        reported with its traceback and leaves the graph as it was; the engine's own jobs raise."""
        graph, failed = self.graph, []
        for job in (lambda g: link.dedup(g, self.task_budget), link.absorb, maintain.rooted):
            done = job(graph)
            graph = Graph(iterate.cut(done.nodes), iterate.cut(done.edges))
        for name, (_, job) in sorted(self.registry.known["maintenance"].items(), key=lambda x: -x[1][0]):
            try:
                done = job(graph)
                graph = Graph(iterate.cut(done.nodes), iterate.cut(done.edges))
            except (ArithmeticError, LookupError, TypeError, ValueError, AnalysisException, PythonException) as e:
                failed.append(f"{name}: {e}\n{traceback.format_exc()}")
        return replace(self, graph=graph)._noted(self.graph), failed

    def report(self) -> DataFrame:
        return quality.graph_quality(self.graph)

    def save(self, folder: str) -> None:
        """The next version of the graph in ``folder``, with what was ingested."""
        store.save(self.graph, folder, done=self.done)
