"""Token costs of nodes, edges and neighbourhoods, and cuts by a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators.graph import Graph


@dataclass(frozen=True)
class WindowSplit:
    """A context window W = system S + task T + reserve R; the reserve is as large as the task's part
    unless given."""

    window: int
    system: int
    reserve: int | None = None

    @property
    def task(self) -> int:
        left = self.window - self.system
        return left // 2 if self.reserve is None else left - self.reserve

    @property
    def merge(self) -> int:
        return 2 * self.task


def rendered(nodes: DataFrame, purpose: str = "decide_hub", focus: bool = True) -> Column:
    """The text of a row of ``nodes``, by its summary (a struct with a text) where they have any."""
    summary = F.col("summary.text") if "summary" in nodes.columns else F.lit(None).cast("string")
    return tx.render_node(F.col("id"), F.col("name"), F.col("content"), summary, purpose, F.lit(focus))


def node_costs(nodes: DataFrame, family: str = "unknown") -> DataFrame:
    """(id, tokens): what a node costs as the focus of a fission decision."""
    return nodes.select("id", tx.estimate(rendered(nodes), family).alias("tokens"))


def named_edges(graph: Graph) -> DataFrame:
    names = graph.nodes.select("id", "name")
    return (
        graph.edges.join(names.toDF("source_id", "source_name"), "source_id", "left")
        .join(names.toDF("target_id", "target_name"), "target_id", "left")
        .withColumn("line", tx.render_edge(F.col("source_name"), F.col("target_name"), F.col("source_id"), F.col("target_id")))
    )


def edge_costs(graph: Graph, family: str = "unknown") -> DataFrame:
    return named_edges(graph).select("id", "source_id", "target_id", "type", tx.estimate(F.col("line"), family).alias("tokens"))


def active_view_costs(graph: Graph, family: str = "unknown") -> DataFrame:
    """(id, tokens): a node, its children, and its edges out and in. One pass over the edges gives what a pair of nodes adds to
    either end; what ends at no node goes last, after it has been summed up."""
    own = node_costs(graph.nodes, family)
    child = own.groupBy(F.col("id").alias("target_id")).agg(F.sum("tokens").alias("below"))
    met = edge_costs(graph, family).join(child, "target_id", "left")  # a child counts once however many edges lead to it
    pairs = met.groupBy("source_id", "target_id").agg(F.sum("tokens").alias("edges"), F.max(F.when(F.col("type") == "assoc", F.col("below"))).alias("below"))
    row = lambda end, tokens: F.struct(F.col(end).alias("id"), tokens.alias("tokens"), F.lit(False).alias("known"))
    ends = pairs.select(F.inline(F.array(row("source_id", F.col("edges") + F.coalesce("below", F.lit(0))), row("target_id", F.col("edges")))))
    parts = own.select("id", F.col("tokens").cast("long").alias("tokens"), F.lit(True).alias("known")).unionAll(ends)
    return parts.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.max("known").alias("known")).where("known and id is not null").select("id", "tokens")


def hierarchy_costs(graph: Graph, family: str = "unknown") -> DataFrame:
    """(id, members, tokens): full costs of a node and all it drills down to, summed up."""
    own = node_costs(graph.nodes, family)
    child = own.groupBy(F.col("id").alias("child")).agg(F.count("*").alias("times"), F.sum("tokens").alias("tokens"))
    down = graph.edges.where("type = 'assoc'").select(F.col("source_id").alias("me"), F.col("target_id").alias("child"))
    pairs = down.join(child, "child").select("me", "child", "times", "tokens").distinct()  # where the join has brought them together
    children = pairs.groupBy("me").agg(F.sum("times").alias("members"), F.sum("tokens").alias("below"))
    joined = own.join(children, F.col("id") == F.col("me"), "left")
    return joined.select("id", F.coalesce("members", F.lit(0)).alias("members"), (F.col("tokens") + F.coalesce("below", F.lit(0))).alias("tokens"))


def over_budget(graph: Graph, budget: int, family: str = "unknown") -> DataFrame:
    """Nodes whose hierarchy costs more than the budget, with members and tokens."""
    return hierarchy_costs(graph, family).where(F.col("tokens") > budget)


#: Lengths of a node's text in full and, as a member, in short.
SIZES = ["cjk", "len", "s_cjk", "s_len"]


def sized_texts(nodes: DataFrame) -> DataFrame:
    """(id, name, content, cjk, len, s_cjk, s_len) of ``nodes``."""
    full, short = rendered(nodes), rendered(nodes, focus=False)
    sizes = (tx.cjk_length(full), F.length(full), tx.cjk_length(short), F.length(short))
    return nodes.select("id", "name", "content", *(c.alias(n) for n, c in zip(SIZES, sizes, strict=True)))


def tokens_of(family: str = "unknown") -> Column:
    """Tokens of a neighbourhood from its node's lengths (cjk, len) and its members' sums (members, m_cjk, m_len), with a
    newline between lines."""
    return tx.estimate_from_lengths(F.col("cjk") + F.col("m_cjk"), F.col("len") + F.col("m_len") + F.col("members"), family)


def neighbourhood_costs(graph: Graph, family: str = "unknown") -> DataFrame:
    """(id, members, tokens) of the one text that renders a node in full and its members in short.

    The estimate isn't additive, so lengths are summed.
    """
    own = sized_texts(graph.nodes)
    short = own.select(F.col("id").alias("child"), "s_cjk", "s_len")
    members = graph.drill_down().join(short, "child").groupBy("me").agg(F.count("*").alias("members"), F.sum("s_cjk").alias("m_cjk"), F.sum("s_len").alias("m_len"))
    joined = own.join(members, F.col("id") == F.col("me"), "left").na.fill(0, ["members", "m_cjk", "m_len"])
    return joined.select("id", "members", tokens_of(family).alias("tokens"))


def trim_prefix(rows: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Per key, the longest beginning whose running cost is within the budget; the first row always.
    Costs are one at least, so that what comes after an overflow overflows as well."""
    window = Window.partitionBy(*keys).orderBy(order)
    running = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).withColumn("_nth", F.row_number().over(window)).where((F.col("running") <= budget) | (F.col("_nth") == 1)).drop("_nth")


def fits(rows: DataFrame, keys: list[str], cost: str, budget: int) -> DataFrame:
    """Per key, the sum of costs and whether it is within the budget."""
    return rows.groupBy(*keys).agg(F.sum(cost).alias("tokens")).withColumn("fits", F.col("tokens") <= budget)


def recall_events(events: DataFrame, limit: int, budget: int, family: str = "unknown") -> DataFrame:
    """Newest ``events`` (id, name, content, event_ts), ties by descending id: (pos, id, line). The newest
    is always there; the list ends at ``limit`` (none if not positive) or where the whole text, header
    included, costs more than the budget.

    Every event costs a token at least, so the budget bounds how many are ranked.
    """
    order = [F.desc_nulls_last(F.expr("nullif(event_ts, '')")), F.desc("id")]
    newest = events.orderBy(*order).limit(max(0, min(limit, budget + 1))).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    lines = newest.withColumn("line", tx.render_event(F.col("pos"), F.col("id"), F.col("event_ts"), F.col("name"), F.col("content")))
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.lit(tx.RECALL_HEADER)
    cjk = F.sum(tx.cjk_length(F.col("line"))).over(upto) + tx.cjk_length(header)
    length = F.sum(F.length("line") + 1).over(upto) + F.length(header)
    costs = lines.withColumn("tokens", tx.estimate_from_lengths(cjk, length, family))
    return costs.where((F.col("tokens") <= budget) | (F.col("pos") == 1)).select("pos", "id", "line", "tokens")


def rendered_list(rows: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Per key, the lines in order under each other; groups are bounded by the budget before."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line).alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def render_facts(nodes: DataFrame, edges: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes, then edges, under one running number per key: (keys, text).

    nodes: keys, pos and node columns; edges: keys, pos, source_id, target_id; names: id, name.
    """
    node_line = F.substring(rendered(nodes, "select_facts"), 2, 1 << 30)
    known = names.select("id", "name")
    edge_rows = edges.join(known.toDF("source_id", "s_name"), "source_id", "left").join(known.toDF("target_id", "t_name"), "target_id", "left")
    edge_line = F.concat(F.lit(" "), tx.render_edge(F.col("s_name"), F.col("t_name"), F.col("source_id"), F.col("target_id")))
    rows = nodes.select(*keys, F.lit(0).alias("kind"), "pos", node_line.alias("line")).unionByName(edge_rows.select(*keys, F.lit(1).alias("kind"), "pos", edge_line.alias("line")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("kind", "pos"))
    numbered = rows.withColumn("number", number).withColumn("line", F.concat(F.col("number").cast("string"), F.lit("."), "line"))
    return rendered_list(numbered, keys, "number", "line")


def estimator_report(samples: DataFrame) -> DataFrame:
    """How estimates compare with true counts: ``samples`` (estimate, true_count)."""
    real = samples.where("true_count > 0").withColumn("ratio", F.col("estimate") / F.col("true_count"))
    return real.agg(
        F.round(F.avg("ratio"), 6).alias("mean_ratio"),
        F.round(100.0 * F.count_if(F.col("estimate") < F.col("true_count")) / F.count("*"), 6).alias("under_pct"),
        F.round(F.max(F.when(F.col("estimate") < F.col("true_count"), F.col("true_count") / F.col("estimate"))), 6).alias("max_under_ratio"),
    )
