"""A log of changes beside the last full version of a graph, for writers that add a little at a time.

A writer puts what each of its batches changed into a folder of its own and then into the list of committed ones, under
its name and the batch's number: a batch that runs again replaces what it wrote, and one that is committed isn't written
twice. Readers merge the log into the version it belongs to; now and then a writer folds it into the next version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.graph import Graph, first_by
from loamgraph.operators.shared import remove_folder
from loamgraph.sources import ledger, store

COMMITTED = "seq long, writer string, batch long, version long"


@dataclass(frozen=True)
class Changes:
    """What a batch changed: nodes and edges that are new or other than before, and ids (id) of those that are gone; ``done``
    (doc_id, chunk_id, content_hash) are chunks that it ingested."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    gone_nodes: DataFrame | None = None
    gone_edges: DataFrame | None = None
    done: DataFrame | None = None


def committed(spark: SparkSession, folder: str) -> list:
    """The committed batches, in order."""
    try:
        return sorted(spark.read.schema(COMMITTED).json(f"{folder}/committed").where("seq is not null").collect())
    except AnalysisException:
        return []


def is_committed(spark: SparkSession, folder: str, writer: str, batch: int) -> bool:
    return any(r.writer == writer and r.batch == batch for r in committed(spark, folder))


def _logged(rows: DataFrame | None, gone: DataFrame | None) -> DataFrame | None:
    if rows is not None:
        rows = rows.withColumn("_op", F.lit("upsert"))
    if gone is not None:
        gone = gone.select("id", F.lit("delete").alias("_op")).distinct()
    if rows is None or gone is None:
        return gone if rows is None else rows
    return rows.unionByName(gone, allowMissingColumns=True)


def commit(spark: SparkSession, folder: str, writer: str, batch: int, changes: Changes) -> bool:
    """Log what ``batch`` of ``writer`` changed. False if that was done before; then nothing is written.

    Writers take turns: two that commit at the same time aren't told apart.
    """
    log = committed(spark, folder)
    if any(r.writer == writer and r.batch == batch for r in log):
        return False
    version = store.versions(spark, folder)[-1]
    seq = log[-1].seq + 1 if log else 0
    at = f"{folder}/log/{writer}-{batch}"
    parts = {"nodes": _logged(changes.nodes, changes.gone_nodes), "edges": _logged(changes.edges, changes.gone_edges), "done": changes.done}
    for name, rows in parts.items():
        if rows is None:
            remove_folder(spark, f"{at}/{name}")
        else:
            rows.withColumn("_seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{at}/{name}")
    spark.createDataFrame([(seq, writer, batch, version)], COMMITTED).coalesce(1).write.mode("append").json(f"{folder}/committed")
    return True


def _log(spark: SparkSession, folder: str, name: str, since: int) -> DataFrame | None:
    """The rows of table ``name`` that batches committed after version ``since`` was written have logged."""
    found = None
    for r in committed(spark, folder):
        if r.version >= since:
            try:
                rows = spark.read.parquet(f"{folder}/log/{r.writer}-{r.batch}/{name}")
            except AnalysisException:  # the batch left this table alone
                continue
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _merged(base: DataFrame, log: DataFrame | None) -> DataFrame:
    """``base`` with the last change of each id. The log is small beside it, so the base isn't shuffled for it."""
    if log is None:
        return base
    last = first_by(log, ["id"], F.desc("_seq"), F.desc("_op"))
    rows = last.where("_op = 'upsert'").drop("_op", "_seq")
    return base.join(last.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def load(spark: SparkSession, folder: str) -> Graph:
    """The newest version with all that was committed since. Edges that touch a deleted node go with it."""
    version = store.versions(spark, folder)[-1:]
    graph = store.load(spark, folder)
    nodes, edges = (_log(spark, folder, name, version[0]) for name in ("nodes", "edges"))
    merged = Graph(_merged(graph.nodes, nodes), _merged(graph.edges, edges))
    if nodes is None or "delete" not in {r[0] for r in nodes.select("_op").distinct().collect()}:
        return merged
    gone = nodes.where("_op = 'delete'").select("id").join(merged.nodes.select("id"), "id", "left_anti").distinct()
    return merged.without_nodes(gone)


def done(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_id, content_hash, bucket) of the chunks ingested so far: the version's and those logged since."""
    version = store.versions(spark, folder)[-1]
    known = store.load_done(spark, folder)
    log = _log(spark, folder, "done", version)
    if log is None:
        return known
    last = first_by(log, ["doc_id", "chunk_id"], F.desc("_seq"))
    return known.join(last.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti").select(known.columns).unionByName(ledger.bucketed(last.where("content_hash is not null")).select(known.columns))


def fold(spark: SparkSession, folder: str) -> int:
    """Write the graph as it is now as the next version, and return its number. Logs that no kept version needs go."""
    version = store.save(load(spark, folder), folder, done=done(spark, folder), keep_meta=True)
    oldest = store.versions(spark, folder)[-store.KEPT_VERSIONS :][0]
    for r in committed(spark, folder):
        if r.version < oldest:
            remove_folder(spark, f"{folder}/log/{r.writer}-{r.batch}")
    return version


def logged_since(spark: SparkSession, folder: str) -> int:
    """How many batches the newest version doesn't have."""
    newest = store.versions(spark, folder)[-1]
    return sum(r.version >= newest for r in committed(spark, folder))
