"""Reading and writing graphs, change logs, chunk tables and evaluation data.

A graph is Parquet: nodes partitioned by class, edges by type, meta as key and value. Each save is a version of its
own; readers follow the list of finished versions, so a job that fails, or that reads what it replaces, leaves the old
state whole.
"""

from __future__ import annotations

import random
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.graph import Graph
from loamgraph.operators.ingest import flush
from loamgraph.operators.shared import remove_folder
from loamgraph.sources.ledger import COLUMNS, bucketed

NODE_COLUMNS = ["id", "name", "content", "node_class", "hub", "doc_id", "event_ts", "seq"]
EDGE_COLUMNS = ["id", "source_id", "target_id", "type", "priority"]
SCHEMA_VERSION = "3"
#: Versions that a folder keeps, for readers that are still at work.
KEPT_VERSIONS = 2


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions in ``folder``, the newest last."""
    try:
        return sorted(r.v for r in spark.read.schema("v long").json(f"{folder}/finished").where("v is not null").distinct().collect())
    except AnalysisException:
        return []


def save(graph: Graph, folder: str, extensions: Mapping[str, str] | None = None, done: DataFrame | None = None, keep_meta: bool = False) -> int:
    """Write all of a graph, columns beyond the usual ones too, as the next version, and return its number. The
    folder may be the one that the graph was loaded from. ``extensions``, names and versions, go into meta, unless meta
    stays as it was. ``done`` (doc_id, chunk_id, content_hash) are the chunks ingested so far, kept by bucket."""
    spark = graph.nodes.sparkSession
    before = versions(spark, folder)
    version = before[-1] + 1 if before else 0
    at = f"{folder}/v={version}"
    for name, rows, by in (("nodes", graph.nodes, "node_class"), ("edges", graph.edges, "type")):
        rows.write.mode("overwrite").partitionBy(by).parquet(f"{at}/{name}")
        # a table without rows has no files that tell its columns
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/schema/{name}")
    if done is not None:
        bucketed(done.select(COLUMNS)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/done")
    now = spark.createDataFrame([] if keep_meta else list(provenance(extensions or {}).items()), "key string, value string")
    write_meta(meta(spark, folder), now).write.mode("overwrite").parquet(f"{at}/meta")
    spark.createDataFrame([(version,)], "v long").coalesce(1).write.mode("append").json(f"{folder}/finished")
    for old in before[:-KEPT_VERSIONS + 1]:
        remove_folder(spark, f"{folder}/v={old}")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> Graph:
    """The newest version of a graph, or a given one, with all its columns."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no finished version of a graph in {folder}")
    at = f"{folder}/v={known[-1] if version is None else version}"
    nodes, edges = (spark.read.schema(spark.read.parquet(f"{at}/schema/{name}").schema).parquet(f"{at}/{name}") for name in ("nodes", "edges"))
    rest = lambda df, first: df.select(*first, *(c for c in df.columns if c not in first))
    return Graph(rest(nodes, NODE_COLUMNS), rest(edges, EDGE_COLUMNS))


def load_done(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_id, content_hash, bucket) of the chunks ingested by the newest version; ``ingest.new_chunks`` reads the
    buckets that it needs."""
    known = versions(spark, folder)
    schema = "doc_id string, chunk_id string, content_hash string, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/v={known[-1]}/done")
    except (AnalysisException, IndexError):  # saved without
        return spark.createDataFrame([], schema)


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """Key and value of the newest version; none if there is none."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], "key string, value string")
    at = f"{folder}/v={known[-1]}"
    later = _meta_writes(spark, at)
    return spark.read.parquet(f"{at}/meta-{later}" if later else f"{at}/meta")


def _meta_writes(spark: SparkSession, at: str) -> int:
    try:
        return spark.read.schema("n int").json(f"{at}/meta-finished").agg(F.max("n")).first()[0] or 0
    except AnalysisException:
        return 0


def set_meta(spark: SparkSession, folder: str, added: DataFrame) -> None:
    """Put key and value rows into the newest version's meta, without a new version of nodes and edges. They are written
    beside the old ones, which hold until the new ones are listed as finished."""
    at = f"{folder}/v={versions(spark, folder)[-1]}"
    n = _meta_writes(spark, at) + 1
    write_meta(meta(spark, folder), added).coalesce(1).write.mode("overwrite").parquet(f"{at}/meta-{n}")
    spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("append").json(f"{at}/meta-finished")


def without_dangling(graph: Graph) -> Graph:
    """Edges that lack an end, and self loops, go; ids stay."""
    return Graph(graph.nodes, graph.within(graph.nodes.select("id")).where("source_id <> target_id").select(graph.edges.columns))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``new``, and what ``old`` has besides; nothing is deleted."""
    return new.unionByName(old.join(new.select("id"), "id", "left_anti").select(new.columns))


def flushed(graph: Graph, node_log: DataFrame, edge_log: DataFrame) -> Graph:
    """The graph after change logs (id, op, seq, value struct): last change wins; edges first lose what
    was deleted and what touched a deleted node."""
    value = lambda log: log.select("id", "op", F.col("value"), F.col("seq"))
    packed = lambda df: df.select("id", F.struct(*df.columns).alias("value"))
    nodes = flush(packed(graph.nodes), value(node_log)).select("value.*")
    edges = flush(packed(graph.edges), value(edge_log)).select("value.*")
    return without_dangling(Graph(nodes, edges))


def write_meta(meta: DataFrame, added: DataFrame) -> DataFrame:
    """Key-value rows with ``added`` ones in place of those of the same key."""
    return added.unionByName(meta.join(added.select("key"), "key", "left_anti").select(added.columns))


def provenance(extensions: Mapping[str, str]) -> dict[str, str]:
    """What meta says about how a graph was written."""
    return {"schema_version": SCHEMA_VERSION, "extensions": ",".join(f"{k}={extensions[k]}" for k in sorted(extensions))}


def provenance_warnings(meta: DataFrame, extensions: Mapping[str, str]) -> list[str]:
    """How stored provenance differs from what is used now; differing data is still read."""
    now = provenance(extensions)
    known = {r.key: r.value for r in meta.where(F.col("key").isin(*now)).collect()}
    return [f"{k}: stored {known[k]}, used {v}" for k, v in now.items() if k in known and known[k] != v]


def encoded_extensions(slots: Mapping[str, Column]) -> Column:
    """An extension bag as JSON text: a field per slot; slots that are null are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in slots.items())))


def read_extensions(raw: Column) -> Column:
    """An extension bag kept as JSON text, as VARIANT; what can't be parsed is null."""
    return F.try_parse_json(raw)


def decoded_extensions(raw: Column, slots: Mapping[str, str]) -> dict[str, Column]:
    """A column per slot of a bag, of its DDL type; a slot that is missing or of another kind is null."""
    bag = F.from_json(raw, ", ".join(f"`{name}` {kind}" for name, kind in slots.items()), {"mode": "PERMISSIVE"})
    return {name: bag[name] for name in slots}


def extension_path(bag: Column, path: str, kind: str = "string") -> Column:
    """One value of a bag by a path like ``$.source_tracking.sources[0].doc_id``, null where it isn't there."""
    return F.try_variant_get(bag, path, kind)


CORPUS = "title string, body string, source string, published_at string, url string, author string, category string"
QUESTIONS = (
    "query string, answer string, question_type string,"
    " evidence_list array<struct<title:string,url:string,source:string,fact:string,published_at:string>>"
)


#: A sample is drawn on the driver by Python's generator, so that seeds mean the same; a benchmark has some hundred titles.
MOST_TITLES = 1_000_000


def read_benchmark(spark: SparkSession, corpus: str, questions: str, sample: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents and questions of a retrieval benchmark in JSON files. A sample takes so many titles and
    the questions whose evidence is among them."""
    docs = spark.read.schema(CORPUS).json(corpus, multiLine=True)
    asked = spark.read.schema(QUESTIONS).json(questions, multiLine=True)
    if sample is None:
        return docs, asked
    titles = [r.title for r in docs.select("title").distinct().orderBy("title").limit(MOST_TITLES + 1).collect()]
    if len(titles) > MOST_TITLES:
        raise ValueError(f"samples are drawn from {MOST_TITLES} titles at most")
    kept = spark.createDataFrame([(t,) for t in random.Random(seed).sample(titles, min(sample, len(titles)))], "title string")
    docs = docs.join(kept, "title", "left_semi")
    rows = asked.withColumn("_id", F.monotonically_increasing_id())
    missing = rows.select("_id", F.explode(F.transform("evidence_list", lambda e: e["title"])).alias("title")).join(kept, "title", "left_anti")
    return docs, rows.join(missing.select("_id"), "_id", "left_anti").drop("_id")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that can't be parsed are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def unfinished(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries without a result yet, for a run that goes on where it stopped."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")
