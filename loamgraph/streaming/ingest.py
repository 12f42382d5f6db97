"""Ingest as a stream: event nodes, chunks once each, newest events per node, the graph itself, and time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loamgraph.operators import ingest
from loamgraph.operators.graph import first_by
from loamgraph.operators.ingest import chunk_keys, event_nodes
from loamgraph.sources import changes, ledger

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "event_id string, event_ts string"
NEWEST = f"target_id string, nth int, {EVENT}"
#: Inputs of a batch (ingest_id, content, ts, ...) to the decisions about them.
Decide = Callable[[DataFrame], DataFrame]


def timeline(inputs: DataFrame) -> DataFrame:
    """Event nodes of a stream of inputs (ingest_id, content, ts)."""
    return event_nodes(inputs)


def ingest_once(spark: SparkSession, chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each chunk (doc_id, chunk_id, content) of a stream to ``out``/chunks whenever its content is other than before.

    A batch asks the ledger in ``out``/ledger, of which it reads the buckets that may know one of its chunks, by what
    earlier batches have put there. It writes to a folder of its own number, so a batch that runs again replaces what it
    wrote before. Of contents of one chunk in one batch the least holds.
    """

    def commit(batch: DataFrame, number: int) -> None:
        keyed = chunk_keys(first_by(batch, ["doc_id", "chunk_id"], F.col("content")))
        added = ledger.fresh(spark, keyed, f"{out}/ledger", number)
        added.select("doc_id", "chunk_id", "content", "content_hash").write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        written = spark.read.schema("doc_id string, chunk_id string, content string, content_hash string").parquet(f"{out}/chunks/batch={number}")
        ledger.append(written, f"{out}/ledger", number)

    return chunks.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Newest(StatefulProcessor):
    """The newest events of a node: a list of so many at most, in the state store."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {tuple(e) for e in self.events.get()} if self.events.exists() else set()
        before = held
        for part in rows:
            held = held | {(e, None if pd.isna(t) else t) for e, t in zip(part["event_id"], part["event_ts"], strict=True)}
            # those without a time last, ties by id
            ranked = sorted(sorted(held, key=lambda e: e[0]), key=lambda e: e[1] or "", reverse=True)
            held = set(ranked[: self.most])
        kept = [e for e in ranked if e in held]
        if held != before:
            self.events.put(kept)
            yield pd.DataFrame([(key[0], n + 1, *e) for n, e in enumerate(kept)], columns=["target_id", "nth", "event_id", "event_ts"])

    def close(self) -> None:
        pass


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def newest_events(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, most: int) -> StreamingQuery:
    """Keep the newest ``most`` events (target_id, event_id, event_ts) per node of a stream, as ``newest_of`` reads them.

    Each node's list is state in RocksDB, so a batch reads and writes the nodes that it has events of and no others; their
    new lists are what it puts into ``out``.
    """
    keyed = events.select("target_id", "event_id", "event_ts").groupBy("target_id")
    lists = keyed.transformWithStateInPandas(Newest(most), outputStructType=NEWEST, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _set(spark, PROVIDER, ROCKS_DB):
        return lists.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_of(spark: SparkSession, out: str) -> DataFrame:
    """(target_id, nth, event_id, event_ts): each node's newest events by the last batch that had any of it."""
    rows = spark.read.schema(f"{NEWEST}, batch long").option("basePath", out).parquet(out)
    last = rows.groupBy("target_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["target_id", "batch"], "left_semi").select("target_id", "nth", "event_id", "event_ts")


def write_graph(spark: SparkSession, inputs: DataFrame, folder: str, decide: Decide, checkpoint: str, writer: str = "ingest", fold_every: int = 25) -> StreamingQuery:
    """Ingest a stream of inputs (ingest_id, content, ts, and maybe doc_id, chunk_id) into the graph in ``folder``.

    Each batch logs the nodes, edges and chunks that it changed beside the last full version, once by its number: a batch
    that ran before the stream was stopped is passed over when it runs again. After ``fold_every`` logged batches the
    next version is written.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if changes.is_committed(spark, folder, writer, number):
            return
        batch = batch.persist()
        applied = ingest.apply(changes.load(spark, folder), batch, decide(batch), done=changes.done(spark, folder))
        changes.commit(spark, folder, writer, number, changes.Changes(nodes=applied.new_nodes, edges=applied.new_edges, done=applied.new_done))
        batch.unpersist()
        if changes.logged_since(spark, folder) >= fold_every:
            changes.fold(spark, folder)

    return inputs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) per hour and type; an addition to what is specified."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("hour"), "event_type", "n", "value"
    )
