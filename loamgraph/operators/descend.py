"""Going down from the root, level by level, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import rank
from loamgraph.operators.graph import ROOT, Graph, first_by
from loamgraph.operators.shared import cut

#: Candidates of a level (query_id, query, id, name, content, seq) to those to go on with: (query_id, id, place).
Chooser = Callable[[DataFrame], DataFrame]


def lexical_chooser(candidates: DataFrame) -> DataFrame:
    """A stand-in for a language model: candidates that share a word with the query, by falling score, then seq and id."""
    scored = rank.lexical_scores(candidates).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "id"))
    return scored.select("query_id", "id", place.alias("place"))


def _first(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "id"))).where(F.col("_nth") <= most)


def descend(graph: Graph, queries: DataFrame, choose: Chooser = lexical_chooser, depth: int = 3, most: int = 10) -> DataFrame:
    """(query_id, id, level, place): where each query (query_id, query) lands, the first ``most`` by level, then place.

    From the root, or from hubs where there is none, ``choose`` is shown what lies below the nodes it chose last, each node once
    in a descent, up to ``depth`` levels. What it names that it wasn't shown is passed over. As levels come in order, a
    query goes on with no more nodes than it has places left, and ends when it has none: a beam that loses nothing.
    A query that lands nowhere gets what is right below the root, or the hubs, as level 0, by seq. Repeated query_ids count once;
    a null query matches nothing.
    """
    asked = cut(queries.groupBy("query_id").agg(F.min("query").alias("query")))
    nodes = graph.nodes.select("id", "name", "content", "seq")
    down = graph.drill_down()
    top = graph.nodes.where(F.col("id") == ROOT).select("id")
    from_root = top.limit(1).count() > 0
    starts = cut(top if from_root else graph.hubs().select("id"))
    # each query begins at the one root, or at each hub
    frontier = asked.select("query_id").join(starts, F.lit(True))
    visited = frontier = cut(frontier)
    landed = None
    for level in range(1, depth + 1):
        below = frontier.join(down, F.col("id") == F.col("me")).select("query_id", F.col("child").alias("id")).distinct()
        shown = cut(below.join(visited, ["query_id", "id"], "left_anti").join(nodes, "id").join(asked, "query_id").select("query_id", "query", "id", "name", "content", "seq"))
        named = first_by(choose(shown).select("query_id", "id", "place"), ["query_id", "id"], F.col("place"))
        known = named.join(shown.select("query_id", "id"), ["query_id", "id"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))
        used = F.lit(0) if landed is None else F.coalesce("used", F.lit(0))
        if landed is not None:
            known = known.join(landed.groupBy("query_id").agg(F.count("*").alias("used")), "query_id", "left")
        chosen = cut(known.withColumn("place", nth).where(F.col("place") + used <= most).select("query_id", "id", F.lit(level).alias("level"), "place"))
        if not chosen.limit(1).count():
            break
        landed = chosen if landed is None else landed.unionByName(chosen)
        visited = visited.unionByName(shown.select("query_id", "id"))
        frontier = chosen.select("query_id", "id")
    seeds = graph.nodes.join(down.join(starts, F.col("me") == F.col("id")).select(F.col("child").alias("id")).distinct(), "id", "left_semi") if from_root else graph.hubs()
    first = seeds.select("id", "seq").orderBy("seq", "id").limit(most)
    lost = asked.select("query_id") if landed is None else asked.join(landed.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    ranked = _first(lost.join(F.broadcast(first), F.lit(True)), most)
    rest = ranked.select("query_id", "id", F.lit(0).alias("level"), F.col("_nth").alias("place"))
    return rest if landed is None else landed.unionByName(rest)
