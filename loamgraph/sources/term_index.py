"""Postings of names and aliases that are kept, and brought up to date instead of built anew for each query.

An index is a list of parts: a full one, and behind it one per update with the postings that came and went. Postings are
partitioned by a hash of their term, so that a lookup reads the buckets of its words only; beside them, by a hash of
their node, are the terms that each node has, so that an update reads the buckets of its nodes only. Parts have names of
their own and are never written again; the list is appended to ``heads`` when its last part is whole. A writer that dies
before leaves the index as it was. A handle keeps to the list it was opened with, whatever others add.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators import search
from loamgraph.operators.shared import cut, remove_folder
from loamgraph.sources.ledger import within

#: Buckets of an index, unless it is built with more: one should be small enough to be read for a lookup.
BUCKETS = 64
#: Updates after which the parts are written as one.
FOLD_EVERY = 25
HEADS = "head long, fold long, buckets int, parts array<string>, writers map<string,long>"
POSTINGS = "term string, id string, added boolean, bucket int"
ENTRIES = "id string, terms array<string>, bucket int"


def named(nodes: DataFrame) -> DataFrame:
    """(id, name, aliases) of nodes with an id; no aliases are an empty array."""
    none = F.array().cast("array<string>")
    aliases = F.array_sort(F.coalesce("aliases", none)) if "aliases" in nodes.columns else none
    return nodes.where("id is not null").select("id", "name", aliases.alias("aliases"))


def _postings(nodes: DataFrame) -> DataFrame:
    rows = named(nodes)
    return search.postings(rows, rows.select("id", F.explode("aliases").alias("alias"))).select("term", "id")


def differences(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an index has to know of two states of nodes: (id, name, aliases) of those that are new or called otherwise, and
    (id) of those that are gone."""
    old, new = named(before), named(after)
    known = old.select("id", F.struct("name", "aliases").alias("_was"))
    changed = new.join(known, "id", "left").where(~F.struct("name", "aliases").eqNullSafe(F.col("_was"))).drop("_was")
    return changed, old.select("id").join(new.select("id"), "id", "left_anti")


@dataclass(frozen=True)
class TermIndex:
    """An index in ``folder``, which all executors share."""

    spark: SparkSession
    folder: str
    parts: tuple[str, ...]
    head: int = 0
    folds: int = 0
    buckets: int = BUCKETS
    writers: dict[str, int] = field(default_factory=dict)  #: the last batch of each writer

    @classmethod
    def build(cls, nodes: DataFrame, folder: str, buckets: int = BUCKETS) -> TermIndex:
        """The index of all ``nodes`` (id, name, and maybe aliases), in place of what ``folder`` had."""
        spark = nodes.sparkSession
        index = cls.open(spark, folder) or cls(spark, folder, (), head=-1, folds=-1)
        return replace(index, buckets=buckets)._refounded(_postings(nodes))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TermIndex | None:
        """The index as it was committed last; none if there is none."""
        try:
            last = spark.read.schema(HEADS).json(f"{folder}/heads").where("head is not null").orderBy(F.desc("head")).first()
        except AnalysisException:
            return None
        return last and cls(spark, folder, tuple(last.parts), last.head, last.fold, last.buckets, dict(last.writers or {}))

    def _committed(self) -> TermIndex:
        row = (self.head, self.folds, self.buckets, list(self.parts), self.writers)
        self.spark.createDataFrame([row], HEADS).coalesce(1).write.mode("append").json(f"{self.folder}/heads")
        return self

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that ``keys`` are in: as many at most as the index has."""
        return sorted(r.bucket for r in keys.select(self._bucket(key).alias("bucket")).distinct().collect())

    def _write(self, part: str, postings: DataFrame, entries: DataFrame) -> None:
        dealt = postings.select("term", "id", "added", self._bucket("term").alias("bucket"))
        held = entries.select("id", "terms", self._bucket("id").alias("bucket"))
        for name, rows in (("postings", dealt), ("entries", held)):  # rebalancing splits the bucket of a term that most nodes have
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{part}/{name}")

    def _refounded(self, postings: DataFrame) -> TermIndex:
        """With one part that holds ``postings`` (term, id). Parts of the list before the last fold go; readers of this one go on."""
        part = uuid.uuid4().hex
        self._write(part, postings.withColumn("added", F.lit(True)), postings.groupBy("id").agg(F.collect_set("term").alias("terms")))
        done = replace(self, parts=(part,), head=self.head + 1, folds=self.folds + 1)._committed()
        if self.folds > 0:
            heads = self.spark.read.schema(HEADS).json(f"{self.folder}/heads").where(F.col("fold") == self.folds - 1)
            for r in heads.select(F.explode("parts").alias("part")).distinct().collect():
                remove_folder(self.spark, f"{self.folder}/{r.part}")
        return done

    def _read(self, name: str, schema: str, parts: tuple[str, ...], buckets: list[int] | None) -> DataFrame:
        """Rows of parts with the place of their part; those of some buckets only."""
        found = [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{part}/{name}").withColumn("_seq", F.lit(self.parts.index(part)))
            for part in parts
        ]
        rows = reduce(DataFrame.unionByName, found)
        return rows if buckets is None else rows.where(within(buckets))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id) as of now, of all terms or of some (term). The full part isn't shuffled for what came behind it,
        unless that is large."""
        buckets = None if terms is None else self._buckets(terms, "term")
        asked = (lambda df: df) if terms is None else (lambda df: df.join(terms.select("term").distinct(), "term", "left_semi"))
        full = asked(self._read("postings", POSTINGS, self.parts[:1], buckets)).select("term", "id")
        if len(self.parts) == 1:
            return full
        later = asked(self._read("postings", POSTINGS, self.parts[1:], buckets))
        last = later.groupBy("term", "id").agg(F.max_by("added", "_seq").alias("added"))
        return full.join(last.select("term", "id"), ["term", "id"], "left_anti").unionByName(last.where("added").select("term", "id"))

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, pos) as ``search.lookup`` gives it, from the buckets of the words of ``queries``."""
        words = queries.select(F.explode(tx.tokens(F.col("query"))).alias("term")).distinct()
        return search.lookup(queries, self.postings(words))

    def updated(self, changed: DataFrame | None = None, gone: DataFrame | None = None, writer: str | None = None, batch: int = 0) -> TermIndex:
        """The index after nodes of ``changed`` (id, name, and maybe aliases) came or are called otherwise, and those of
        ``gone`` (id) went; a node in both is there. Rows that repeat an id give that node all their names. A ``batch`` of
        a ``writer``, whose numbers rise, counts once, however often it is given. Writers take turns."""
        if writer is not None and self.writers.get(writer, -1) >= batch:
            return self
        schema = "id string, name string, aliases array<string>"
        changed = self.spark.createDataFrame([], schema) if changed is None else cut(named(changed))
        ids = changed.select("id")
        if gone is not None:
            ids = ids.unionByName(gone.where("id is not null").select("id"))
        ids, now = cut(ids.distinct()), _postings(changed)
        held = self._read("entries", ENTRIES, self.parts, self._buckets(ids, "id")).join(ids, "id", "left_semi")
        before = held.groupBy("id").agg(F.max_by(F.struct("terms"), "_seq").alias("last")).select(F.explode("last.terms").alias("term"), "id")
        both = now.withColumn("n", F.lit(1)).unionByName(before.withColumn("n", F.lit(-1)))
        moved = both.groupBy("term", "id").agg(F.sum("n").alias("n")).where("n <> 0").select("term", "id", (F.col("n") > 0).alias("added"))
        part = uuid.uuid4().hex
        self._write(part, moved, ids.join(now.groupBy("id").agg(F.collect_set("term").alias("terms")), "id", "left"))
        writers = self.writers if writer is None else {**self.writers, writer: batch}
        done = replace(self, parts=(*self.parts, part), head=self.head + 1, writers=writers)._committed()
        return done.folded() if len(done.parts) > FOLD_EVERY else done

    def folded(self) -> TermIndex:
        """With all parts written as one."""
        return self._refounded(self.postings())
