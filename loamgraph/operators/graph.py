"""Typed nodes and edges: adjacency, lookups, validation and mutations.

nodes: id, name, content, node_class, hub, doc_id, event_ts, seq. Class is concept, fact, event or
source; concept and fact are core. seq is the order of insertion.
edges: id, source_id, target_id, type (assoc, mutex), priority.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.shared import cut

CLASSES = ["concept", "fact", "event", "source"]
TYPES = ["assoc", "mutex"]
ROOT = "__seed_root__"


def is_core(node_class: Column) -> Column:
    return node_class.isin("concept", "fact")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: So many ids are sent to all tasks, instead of shuffling what is looked up by them.
FEW = 500_000


def few_sent(ids: DataFrame) -> DataFrame:
    """``ids`` once each, with the hint that they are few where they are."""
    once = ids.distinct()
    return F.broadcast(once) if once.limit(FEW + 1).count() <= FEW else once


def shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``, null where there are none."""
    have = set(rows.columns)
    return rows.select(*(F.col(f"`{c}`") if c in have else F.lit(None).cast(t).alias(c) for c, t in like.dtypes))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # lookups
    def node(self, id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Nodes for ``ids`` (pos, id): repeated ids repeat, unknown ones go; order by pos."""
        return ids.join(self.nodes, "id")

    def of_class(self, node_class: str) -> DataFrame:
        return self.nodes.where(F.col("node_class") == node_class)

    def hubs(self) -> DataFrame:
        return self.nodes.where("hub")

    # adjacency
    def both_ends(self) -> DataFrame:
        """Every edge from either of its ends: me, other, edge_id, type. A self loop shows once."""
        ends = self.edges.select(F.col("source_id").alias("me"), F.col("target_id").alias("other"), F.col("id").alias("edge_id"), "type")
        back = ends.where("me <> other").select(F.col("other").alias("me"), F.col("me").alias("other"), "edge_id", "type")
        return ends.unionByName(back)

    def _classed(self, near: DataFrame | None = None) -> DataFrame:
        """Edges from either of their ends, as ``both_ends`` with down (from the source), and what is known of both ends: me_class,
        me_known, other_class, other_known. Each edge meets with nodes once and is turned after; with ``near`` (id) just what
        starts there meets with nodes at all."""
        classes = self.nodes.select("id", "node_class", F.lit(True).alias("known"))
        if near is not None:
            out = self.edges.select(F.col("source_id").alias("me"), F.col("target_id").alias("other"), F.col("id").alias("edge_id"), "type", F.lit(True).alias("down"))
            back = out.where("me <> other").select(F.col("other").alias("me"), F.col("me").alias("other"), "edge_id", "type", F.lit(False).alias("down"))
            ends = out.unionByName(back).join(near.select(F.col("id").alias("me")), "me", "left_semi")
            return ends.join(classes.toDF("me", "me_class", "me_known"), "me", "left").join(classes.toDF("other", "other_class", "other_known"), "other", "left")
        edges = self.edges.select("id", "source_id", "target_id", "type")
        met = edges.join(classes.toDF("source_id", "s_class", "s_known"), "source_id", "left").join(classes.toDF("target_id", "t_class", "t_known"), "target_id", "left")
        names = ("me", "other", "me_class", "me_known", "other_class", "other_known", "down")
        row = lambda *columns: F.struct(*(c.alias(n) for n, c in zip(names, columns, strict=True)))
        col = F.col
        forth = row(col("source_id"), col("target_id"), col("s_class"), col("s_known"), col("t_class"), col("t_known"), F.lit(True))
        back = row(col("target_id"), col("source_id"), col("t_class"), col("t_known"), col("s_class"), col("s_known"), F.lit(False))
        turned = F.when(col("source_id") != col("target_id"), F.array(forth, back)).otherwise(F.array(forth))
        return met.select(col("id").alias("edge_id"), "type", F.inline(turned))

    @staticmethod
    def _seen(ends: DataFrame) -> DataFrame:
        """(me, edge_id, type, other) of ``_classed`` that relations show."""
        hidden = is_core(F.col("me_class")) & (F.col("type") == "assoc") & F.col("other_class").eqNullSafe("event")
        return ends.where(F.col("me_known") & ~hidden).select("me", "edge_id", "type", "other")

    @staticmethod
    def _below(ends: DataFrame) -> DataFrame:
        """(me, child) of ``_classed`` that drill-down shows."""
        return ends.where("down and type = 'assoc' and other_known").select("me", F.col("other").alias("child")).distinct()

    def relations(self, limit: int | None = None) -> DataFrame:
        """(me, edge_id, type, other) for known nodes. A core node doesn't see its events by assoc;
        events do see core nodes, so this isn't symmetric. A limit takes the least edge ids."""
        seen = self._seen(self._classed())
        if limit is None:
            return seen
        nth = F.row_number().over(Window.partitionBy("me").orderBy("edge_id"))
        return seen.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")

    def shown_to_core(self) -> DataFrame:
        """(id) of all ends of edges that a core node there sees: those that ``relations`` of core nodes have. Of the other end
        just whether it is an event matters, so edges meet with events only."""
        events = self.nodes.where("node_class = 'event'").select("id").distinct()
        edges = self.edges.select("source_id", "target_id", "type")
        for end, flag in (("source_id", "from_event"), ("target_id", "to_event")):
            edges = edges.join(events.select(F.col("id").alias(end), F.lit(True).alias(flag)), end, "left")
        shown = lambda end, event: F.when((F.col("type") != "assoc") | F.col(event).isNull(), F.col(end))
        return edges.select(F.explode(F.array(shown("source_id", "to_event"), shown("target_id", "from_event"))).alias("id")).where("id is not null").distinct()

    def drill_down(self) -> DataFrame:
        """(me, child) for assoc edges out of a node to one that exists."""
        out = self.edges.where("type = 'assoc'").select(F.col("source_id").alias("me"), F.col("target_id").alias("child"))
        return out.join(self.nodes.select(F.col("id").alias("child")), "child", "left_semi").distinct()

    def related_events(self, limit: int | None = None) -> DataFrame:
        """(node_id, event_id, event_ts, nth): events with an assoc edge into the node, newest first,
        those without a time last, ties by id."""
        events = self.of_class("event").select(F.col("id").alias("event_id"), "event_ts")
        into = self.edges.where("type = 'assoc'").select(F.col("source_id").alias("event_id"), F.col("target_id").alias("node_id"))
        order = Window.partitionBy("node_id").orderBy(F.desc_nulls_last(F.expr("nullif(event_ts, '')")), "event_id")
        ranked = into.distinct().join(events, "event_id").withColumn("nth", F.row_number().over(order))
        ranked = ranked.select("node_id", "event_id", "event_ts", "nth")
        return ranked if limit is None else ranked.where(F.col("nth") <= limit)

    def edges_between(self, pairs: DataFrame) -> DataFrame:
        """Edges of any type for ordered ``pairs`` (source_id, target_id)."""
        return self.edges.join(pairs.distinct(), ["source_id", "target_id"], "left_semi")

    def neighbours(self) -> DataFrame:
        """(me, other) without direction: what drill-down and relations reach."""
        hidden = is_core(F.col("me_class")) & (F.col("type") == "assoc") & F.col("other_class").eqNullSafe("event")
        down = F.col("down") & (F.col("type") == "assoc") & F.col("other_known")
        return self._classed().where((F.col("me_known") & ~hidden) | down).select("me", "other").distinct()

    def steps(self, near: DataFrame, back: bool = False) -> DataFrame:
        """The rows of ``neighbours`` (me, other) that start at ids of ``near`` (id), or that end there. Only their edges meet
        with nodes, so that work follows the surroundings of ``near``; edges are read, but shuffled only if ``near`` is large."""
        out = self.edges.select(F.col("source_id").alias("me"), F.col("target_id").alias("other"), "type", F.lit(True).alias("down"))
        into = self.edges.where("source_id <> target_id").select(F.col("target_id").alias("me"), F.col("source_id").alias("other"), "type", F.lit(False).alias("down"))
        key = "other" if back else "me"
        ends = out.unionAll(into).join(near.select(F.col("id").alias(key)), key, "left_semi")
        classes = self.nodes.select("id", "node_class")
        ends = ends.join(classes.toDF("me", "me_class"), "me", "left").join(classes.toDF("other", "other_class"), "other", "left")
        assoc = F.col("type") == "assoc"
        hidden = is_core(F.col("me_class")) & assoc & (F.coalesce("other_class", F.lit("")) == "event")
        seen = (F.col("me_class").isNotNull() & ~hidden) | (F.col("down") & assoc & F.col("other_class").isNotNull())
        return ends.where(seen).select("me", "other").distinct()

    def degrees(self, near: DataFrame | None = None) -> DataFrame:
        """(id, degree): drilled-down nodes and relations together; an assoc edge out counts twice. ``near`` (id, each once) takes just those."""
        ends = self._classed(near)
        counted = self._below(ends).select("me").unionAll(self._seen(ends).select("me")).groupBy("me").agg(F.count("*").alias("degree"))
        ids = self.nodes.select("id") if near is None else self.nodes.select("id").join(near, "id", "left_semi")
        return ids.join(counted, F.col("id") == F.col("me"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def view(self, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For ``focus`` (me): neighbours (me, other, degree), and edges as (me, edge_id, other), the
        drill-down as ``hierarchy::me::child``. Only what is around the focus meets with nodes."""
        near = few_sent(focus.select(F.col("me").alias("id")))
        around = cut(self.steps(near).where("me <> other"))
        degrees = self.degrees(few_sent(around.select(F.col("other").alias("id"))))
        known = around.join(degrees.withColumnRenamed("id", "other"), "other").select("me", "other", "degree")
        ends = self._classed(near)
        down = self._below(ends).select("me", F.concat(F.lit("hierarchy::"), "me", F.lit("::"), "child").alias("edge_id"), F.col("child").alias("other"))
        return known, down.unionByName(self._seen(ends).select("me", "edge_id", "other"))

    def node_views(self, focus: DataFrame) -> DataFrame:
        """(me, pos, id): a node and what is around it, itself first, the others by seq then id."""
        around = self.neighbours().join(focus, "me", "left_semi").where("me <> other").join(
            self.nodes.select(F.col("id").alias("other"), "seq"), "other"
        )
        own = focus.join(self.nodes.select(F.col("id").alias("me")), "me", "left_semi")
        rows = own.select("me", F.col("me").alias("id"), F.lit(-1).cast("long").alias("seq")).unionByName(around.select("me", F.col("other").alias("id"), "seq"))
        pos = F.row_number().over(Window.partitionBy("me").orderBy("seq", "id"))
        return rows.select("me", pos.alias("pos"), "id")

    def within(self, ids: DataFrame) -> DataFrame:
        """Edges of which both ends are in ``ids`` (id)."""
        ids = ids.select("id").distinct()
        return self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
            ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
        )

    # mutations give new graphs
    def without_nodes(self, ids: DataFrame) -> Graph:
        """Nodes of ``ids`` (id) and every edge that touches them go."""
        ids = ids.select("id").distinct()
        edges = self.edges
        for end in ("source_id", "target_id"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        return Graph(self.nodes.join(ids, "id", "left_anti"), edges.select(self.edges.columns))

    def without_edges(self, ids: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(ids.select("id").distinct(), "id", "left_anti"))

    def with_nodes(self, added: DataFrame) -> Graph:
        """Insert or replace nodes by id; of rows with one id the last by seq holds."""
        check_classes(added)
        return Graph(latest(self.nodes.unionByName(added, allowMissingColumns=True), ["id"]), self.edges)

    def with_edges(self, added: DataFrame) -> Graph:
        """Add edges by the rules of ``valid_edges``; known ones win over added ones. Columns that only one side has stay."""
        known = self.edges.withColumn("seq", F.lit(0).cast("long"))
        fresh = added.withColumn("seq", F.monotonically_increasing_id() + 1) if "seq" not in added.columns else added.withColumn("seq", F.col("seq") + 1)
        both = known.unionByName(fresh, allowMissingColumns=True)
        return Graph(self.nodes, valid_edges(both, self.nodes).select([c for c in both.columns if c != "seq"]))

    def updated_nodes(self, changes: DataFrame) -> Graph:
        """``changes`` has id and some columns of nodes; null means unchanged, unknown ids nothing."""
        if "node_class" in changes.columns:
            check_classes(changes)
        return Graph(_updated(self.nodes, changes), self.edges)

    def updated_edges(self, changes: DataFrame) -> Graph:
        """The same for edges; an unknown type, or a mutex edge between others than facts, is an error."""
        edges = _updated(self.edges, changes)
        touched = edges.join(changes.select("id"), "id", "left_semi")
        bad = edge_faults(touched, self.nodes).where("fault in ('unknown type', 'mutex needs facts')").limit(1).collect()
        if bad:
            raise ValueError(f"edge {bad[0].id}: {bad[0].fault}")
        return Graph(self.nodes, edges)


def _updated(rows: DataFrame, changes: DataFrame) -> DataFrame:
    named = [c for c in changes.columns if c != "id" and c in rows.columns]
    joined = rows.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in named)), "id", "left")
    return joined.select([F.coalesce(f"_{c}", c).alias(c) if c in named else F.col(f"`{c}`") for c in rows.columns])


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(rows, keys, F.col("seq").desc())


def check_classes(nodes: DataFrame) -> None:
    bad = nodes.where(~F.col("node_class").isin(CLASSES)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown node class: {bad[0].node_class}")


def edge_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with fault: null, or why the edge isn't stored. Unknown types and mutex edges
    between others than facts are errors; self loops and missing ends are passed over."""
    source = nodes.select(F.col("id").alias("source_id"), F.col("node_class").alias("_source"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("node_class").alias("_target"))
    fault = (
        F.when(~F.col("type").isin(TYPES), "unknown type")
        .when(F.col("source_id") == F.col("target_id"), "self loop")
        .when(F.col("_source").isNull() | F.col("_target").isNull(), "missing end")
        .when((F.col("type") == "mutex") & ((F.col("_source") != "fact") | (F.col("_target") != "fact")), "mutex needs facts")
    )
    return edges.join(source, "source_id", "left").join(target, "target_id", "left").withColumn("fault", fault).drop("_source", "_target")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (..., seq) without faults and repeats: the first by seq of each ordered pair for
    assoc, of each unordered pair for mutex."""
    kept = edge_faults(edges, nodes).where("fault is null").drop("fault")
    ordered = F.col("type") == "assoc"
    a = F.when(ordered, F.col("source_id")).otherwise(F.least("source_id", "target_id"))
    b = F.when(ordered, F.col("target_id")).otherwise(F.greatest("source_id", "target_id"))
    return first_by(kept.withColumns({"_a": a, "_b": b}), ["type", "_a", "_b"], F.col("seq"), F.col("id")).drop("_a", "_b", "seq")
