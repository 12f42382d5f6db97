"""Finding nodes by words: postings of names and aliases, lookups, and merging entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators.graph import first_by


def postings(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(term, id): each node's name and aliases (id, alias), and all tokens of them. Case counts."""
    entries = nodes.select("id", F.col("name").alias("entry"))
    if aliases is not None:
        entries = entries.unionByName(aliases.select("id", F.col("alias").alias("entry")))
    terms = F.array_distinct(F.concat(F.array("entry"), tx.tokens(F.col("entry"))))
    return entries.where("entry <> ''").select("id", F.explode(terms).alias("term")).distinct()


def updated_postings(index: DataFrame, changed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The index after nodes of ``changed`` (id, name) came or changed; those whose name is null are removed."""
    kept = index.join(changed.select("id").distinct(), "id", "left_anti").select("term", "id")
    mine = None if aliases is None else aliases.join(changed.where("name is not null").select("id").distinct(), "id", "left_semi")
    return kept.unionByName(postings(changed.where("name is not null"), mine).select("term", "id"))


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, pos): nodes that share a token with the query (query_id, query), by the first
    such token. Postings of terms that no query has go before the join."""
    words = queries.select("query_id", F.posexplode(tx.tokens(F.col("query"))).alias("pos", "term"))
    asked = index.join(words.select("term").distinct(), "term", "left_semi")
    return words.join(asked, "term").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))


def merge_entries(hits: DataFrame) -> DataFrame:
    """Hits of several entries (query_id, id, priority, exclusive, pos), in order of priority: the
    first of each id stays, and behind an exclusive entry that has hits only exclusive ones count."""
    top = hits.where("exclusive").groupBy("query_id").agg(F.max("priority").alias("_top"))
    open_ = hits.join(top, "query_id", "left").where(F.col("exclusive") | F.col("_top").isNull() | (F.col("priority") >= F.col("_top")))
    once = first_by(open_.drop("_top"), ["query_id", "id"], F.col("priority").desc(), F.col("pos"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("priority").desc(), "pos", "id"))
    return once.select("query_id", "id", "priority", place.alias("place"))


def trim_by_choice(hits: DataFrame, choice: DataFrame) -> DataFrame:
    """Hits (query_id, id) in the order of a decision's ``choice`` (query_id, ids); unknown ids go."""
    return choice.select("query_id", F.posexplode("ids").alias("pos", "id")).join(hits, ["query_id", "id"]).groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
