"""Bounding neighbourhoods: communities of a hub's members become hubs of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators.budget import SIZES, sized_texts, tokens_of
from loamgraph.operators.graph import Graph, shaped
from loamgraph.operators.ingest import stable_id
from loamgraph.operators.shared import cut

#: Members of centres (center, id, name, content) to communities (center, theme, id).
Decider = Callable[[DataFrame], DataFrame]


def by_first_word(members: DataFrame) -> DataFrame:
    """Communities by the first word of the content; a stand-in for a language model."""
    theme = F.coalesce(F.get(tx.token_set(F.col("content")), 0), F.get(tx.token_set(F.col("name")), 0), F.lit("other"))
    return members.select("center", theme.alias("theme"), "id")


def valid_communities(communities: DataFrame, members: DataFrame) -> DataFrame:
    """Communities (center, theme, strategy, key_id, member_ids) with unknown members dropped, empty ones
    gone, and a key that isn't a member turned into a summary."""
    known = members.groupBy("center").agg(F.collect_set("id").alias("known"))
    kept = communities.join(known, "center").withColumn("member_ids", F.array_intersect("member_ids", "known")).where("size(member_ids) > 0")
    key = F.array_contains("member_ids", F.coalesce("key_id", F.lit("")))
    strategy = F.when((F.col("strategy") == "key_concept") & ~key, "summarize").otherwise(F.col("strategy"))
    return kept.withColumn("strategy", strategy).withColumn("key_id", F.when(key, F.col("key_id"))).drop("known")


def reorganised_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges after a plan (center, hub, id): centre to member goes, hub to member and centre to hub come."""
    gone = plan.select(F.col("center").alias("source_id"), F.col("id").alias("target_id")).distinct()
    come = plan.select(F.col("hub").alias("source_id"), F.col("id").alias("target_id")).union(plan.select("center", "hub")).where("source_id <> target_id")
    return changed_edges(edges, gone, come)


def changed_edges(edges: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Edges without the assoc ones of pairs ``gone`` and with one for each of pairs ``come`` (source_id, target_id) that has
    none. Columns beyond the usual ones stay, and are null in new edges."""
    left = edges.join(gone.withColumn("type", F.lit("assoc")), ["source_id", "target_id", "type"], "left_anti").select(edges.columns)
    fresh = come.distinct().join(left.where("type = 'assoc'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    named = fresh.select(F.concat("source_id", F.lit(">"), "target_id", F.lit(":assoc")).alias("id"), "source_id", "target_id", F.lit("assoc").alias("type"), F.lit(0.0).alias("priority"))
    return left.unionByName(shaped(named, edges))


def similar_hubs(summaries: DataFrame, hubs: DataFrame, least: float = 0.7) -> DataFrame:
    """(key, hub_id): for each summary (key, summary) the first hub (id, content, seq) whose words are as
    like. Pairs meet by shared words, so none without one is formed."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    a = summaries.select("key", F.explode(words(F.col("summary"))).alias("word"), F.size(words(F.col("summary"))).alias("n"))
    b = hubs.select("id", "seq", F.explode(words(F.col("content"))).alias("word"), F.size(words(F.col("content"))).alias("m"))
    met = a.join(b, "word").groupBy("key", "id", "seq", "n", "m").agg(F.count("*").alias("both"))
    alike = met.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= least)
    return alike.groupBy("key").agg(F.min_by("id", F.struct("seq", "id")).alias("hub_id"))


def _planned(centres: DataFrame, links: DataFrame, texts: DataFrame, decide: Decider) -> DataFrame:
    """(center, hub, theme, id): communities of the members of ``centres`` (center) that are worth a hub."""
    members = links.withColumnRenamed("me", "center").join(centres, "center", "left_semi").withColumnRenamed("child", "id")
    members = members.join(texts.select("id", "name", "content"), "id")
    plan = decide(members).where(~tx.is_vacuous(F.concat(F.lit("about "), "theme"))).withColumn("hub", stable_id("hub", "center", "theme"))
    plan = cut(plan.where("id <> center").distinct())
    # a community of all members would only move the neighbourhood one level down
    sizes = members.groupBy("center").agg(F.count("*").alias("of"))
    worth = plan.groupBy("center", "hub").agg(F.count("*").alias("n")).join(sizes, "center").where("n >= 2 and n < of")
    return plan.join(worth.select("hub"), "hub", "left_semi")


def _summed(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, members, tokens) of the texts' neighbourhoods, from the lengths of each text and of its members."""
    below = links.join(texts.select(F.col("id").alias("child"), F.col("s_cjk").alias("cjk"), F.col("s_len").alias("len")), "child")
    sums = below.groupBy(F.col("me").alias("id")).agg(F.count("*").alias("members"), F.sum("cjk").alias("m_cjk"), F.sum("len").alias("m_len"))
    return texts.join(sums, "id", "left").na.fill(0, ["members", "m_cjk", "m_len"]).select("id", "members", tokens_of().alias("tokens"))


def compact(graph: Graph, budget: int, decide: Decider = by_first_word, most_rounds: int = 20, changed: DataFrame | None = None) -> Graph:
    """Split neighbourhoods beyond the budget until none is, or none shrinks; all, or only those of ``changed`` nodes (id) and
    of the nodes above them.

    All centres over budget are split at once; a split holds only where the centre's neighbourhood costs less by it. New
    hubs are looked at in the next round. What a round reads is what surrounds its centres: their links and the lengths
    of their members, kept from round to round and altered by what moved. The graph is read for the first centres and for
    hubs that it has already, and written once, at the end.
    """
    down = graph.drill_down()
    touched = graph.nodes.select("id") if changed is None else changed.select("id").unionByName(down.join(changed.select(F.col("id").alias("child")), "child", "left_semi").select(F.col("me").alias("id"))).distinct()
    lengths = sized_texts(graph.nodes)
    first = _summed(down.join(touched.select(F.col("id").alias("me")), "me", "left_semi"), lengths)
    if changed is not None:
        first = first.join(touched, "id", "left_semi")
    live = cut(first.where((F.col("tokens") > budget) & (F.col("members") >= 2)))
    if live.isEmpty():
        return graph

    def around(centres: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (me, child) out of ``centres`` (id), and texts of both ends."""
        links = cut(down.join(centres.select(F.col("id").alias("me")), "me", "left_semi"))
        ends = links.select(F.col("child").alias("id")).unionByName(centres.select("id")).distinct()
        return links, cut(lengths.join(ends, "id", "left_semi"))

    links, texts = around(live)
    before, fetched = links, live.select("id")
    hubs = texts.limit(0)
    for _ in range(most_rounds):
        plan = cut(_planned(live.select(F.col("id").alias("center")), links, texts, decide))
        if plan.isEmpty():
            break
        named = plan.select(F.col("hub").alias("id"), "theme").distinct()
        # hubs that the graph has from an earlier time come with what they have
        known = cut(named.join(graph.nodes.select("id"), "id", "left_semi").join(fetched, "id", "left_anti").select("id"))
        if not known.isEmpty():
            more, theirs = around(known)
            links, before, fetched = cut(links.unionByName(more).distinct()), cut(before.unionByName(more).distinct()), cut(fetched.unionByName(known))
            texts = cut(texts.unionByName(theirs.join(texts.select("id"), "id", "left_anti")))
        fresh = named.join(texts.select("id"), "id", "left_anti").select("id", tx.short_name(F.col("theme")).alias("name"), F.col("theme").alias("content"))
        fresh = cut(sized_texts(fresh))
        tried = _moved(links, plan)
        own = live.select("id", F.col("tokens").alias("was"))
        now = _summed(tried.join(own.select(F.col("id").alias("me")), "me", "left_semi"), texts.unionByName(fresh)).join(own, "id")
        better = cut(now.where("tokens < was").select(F.col("id").alias("center")))
        plan = cut(plan.join(better, "center", "left_semi"))
        if plan.isEmpty():
            break
        links = cut(_moved(links, plan))
        used = fresh.join(plan.select(F.col("hub").alias("id")), "id", "left_semi")
        hubs, texts = cut(hubs.unionByName(used)), cut(texts.unionByName(used))
        next_ones = plan.select(F.col("hub").alias("id")).union(better).distinct()
        sums = _summed(links.join(next_ones.select(F.col("id").alias("me")), "me", "left_semi"), texts.join(next_ones, "id", "left_semi").unionByName(texts.join(next_ones, "id", "left_anti")))
        live = cut(sums.join(next_ones, "id", "left_semi").where((F.col("tokens") > budget) & (F.col("members") >= 2)))
        if live.isEmpty():
            break

    ends = {"me": "source_id", "child": "target_id"}
    gone, come = before.join(links, list(ends), "left_anti"), links.join(before, list(ends), "left_anti")
    made = hubs.select("id", "name", "content", F.lit("concept").alias("node_class"), F.lit(True).alias("hub"), (F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) + (1 << 60)).alias("seq"))
    nodes = graph.nodes.unionByName(shaped(made, graph.nodes))
    return Graph(cut(nodes), cut(changed_edges(graph.edges, gone.withColumnsRenamed(ends).select("source_id", "target_id"), come.withColumnsRenamed(ends).select("source_id", "target_id"))))


def _moved(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Links (me, child) after a plan (center, hub, id)."""
    left = links.join(plan.select(F.col("center").alias("me"), F.col("id").alias("child")), ["me", "child"], "left_anti")
    come = plan.select(F.col("hub").alias("me"), F.col("id").alias("child")).union(plan.select("center", "hub")).where("me <> child")
    return left.unionByName(come).distinct()
