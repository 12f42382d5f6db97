"""Registered queries over the derived graph, each with the SQL that another engine checks it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators import budget, compact, descend, ingest, iterate, link, maintain, quality, rank, search
from loamgraph.operators.shared import cut, shared_folder
from loamgraph.operators.graph import ROOT, Graph, edge_faults, is_core, valid_edges
from loamgraph.sources import derive, store
from loamgraph.sources.term_index import TermIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_NODES, _EDGES = derive.statements("duckdb", {t: t for t in derive.TABLES})
STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

# Parts of the SQL: tables of the graph, and expressions that several statements share.
GRAPH_SQL = f"""WITH RECURSIVE nodes AS ({_NODES}), edges AS ({_EDGES}),
ends AS (SELECT source_id AS me, target_id AS other, id AS edge_id, type FROM edges
  UNION ALL SELECT target_id, source_id, id, type FROM edges WHERE source_id <> target_id),
relations AS (SELECT e.me, e.edge_id, e.type, e.other FROM ends e JOIN nodes m ON m.id = e.me LEFT JOIN nodes o ON o.id = e.other
  WHERE NOT (m.node_class IN ('concept', 'fact') AND e.type = 'assoc' AND coalesce(o.node_class, '') = 'event')),
drill AS (SELECT DISTINCT e.source_id AS me, e.target_id AS child FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'assoc'),
neighbours AS (SELECT me, child AS other FROM drill UNION SELECT me, other FROM relations)"""


CJK_RANGE = "一-鿿"


def words_sql(text: str) -> str:
    pieces = f"list_filter(string_split_regex(coalesce({text}, ''), '[\\s,.;:!?　，。；！？]+'), lambda p: p <> '')"
    return f"flatten(list_transform({pieces}, lambda p: CASE WHEN regexp_full_match(p, '[{CJK_RANGE}]+') THEN list_concat(string_split(p, ''), [p]) ELSE [p] END))"


def set_sql(text: str) -> str:
    return f"list_distinct(list_filter(list_transform({words_sql(text)}, lambda w: lower(w)), lambda w: w NOT IN ({STOPS})))"


def tokens_sql(text: str) -> str:
    cjk = f"length(regexp_replace({text}, '[^{CJK_RANGE}]', '', 'g'))"
    return f"(CASE WHEN length({text}) > 0 THEN greatest(1, CAST(trunc({cjk} * 1.7 + (length({text}) - {cjk}) // 3) AS BIGINT)) ELSE 0 END)"


def node_sql(prefix: str = "", full: bool = True) -> str:
    """What a node is rendered as; the derived nodes have no summaries."""
    id, name, content = (f"{prefix}{c}" for c in ("id", "name", "content"))
    body = f"coalesce({content}, '')" if full else f"substr(coalesce({content}, ''), 1, 200)"
    return f"'- ' || {name} || ' (id=' || {id} || ')' || CASE WHEN {body} <> '' AND {body} <> {name} THEN chr(10) || '  ' || {body} ELSE '' END"


COSTS_SQL = f"costs AS (SELECT id, {tokens_sql(node_sql())} AS tokens FROM nodes)"


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    return derive.derive_graph(spark, sf_dir)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


# scans and lookups


@query(f"{GRAPH_SQL} SELECT id, name, content, seq FROM nodes WHERE node_class = 'fact'")
def scan_class(spark, sf_dir):
    return graph_of(spark, sf_dir).of_class("fact").select("id", "name", "content", "seq")


@query(f"{GRAPH_SQL} SELECT id, node_class, seq FROM nodes")
def scan_nodes(spark, sf_dir):
    return graph_of(spark, sf_dir).nodes.select("id", "node_class", "seq")


@query(f"{GRAPH_SQL} SELECT id, source_id, target_id, type FROM edges")
def scan_edges(spark, sf_dir):
    return graph_of(spark, sf_dir).edges.select("id", "source_id", "target_id", "type")


@query(f"{GRAPH_SQL} SELECT p.pos, n.id, n.name FROM (VALUES (0, 'c:5'), (1, 'x:1'), (2, 'n:3'), (3, 'c:5')) p(pos, id) JOIN nodes n ON n.id = p.id")
def lookup_batch(spark, sf_dir):
    ids = rows(spark, "pos int, id string", (0, "c:5"), (1, "x:1"), (2, "n:3"), (3, "c:5"))
    return graph_of(spark, sf_dir).lookup(ids).select("pos", "id", "name")


@query(f"{GRAPH_SQL} SELECT id, name FROM nodes WHERE hub")
def hub_scan(spark, sf_dir):
    return graph_of(spark, sf_dir).hubs().select("id", "name")


# adjacency


@query(f"{GRAPH_SQL} SELECT me, edge_id, type, other FROM relations")
def adj_relations(spark, sf_dir):
    return graph_of(spark, sf_dir).relations()


@query(f"{GRAPH_SQL} SELECT me, edge_id, type, other FROM (SELECT *, CAST(row_number() OVER (PARTITION BY me ORDER BY edge_id) AS INT) AS nth FROM relations) WHERE nth <= 3")
def adj_relations_limit(spark, sf_dir):
    return graph_of(spark, sf_dir).relations(limit=3)


@query(f"{GRAPH_SQL} SELECT me, child FROM drill")
def adj_drilldown(spark, sf_dir):
    return graph_of(spark, sf_dir).drill_down()


@query(
    f"""{GRAPH_SQL} SELECT node_id, event_id, event_ts, nth FROM (
    SELECT e.target_id AS node_id, n.id AS event_id, n.event_ts,
           CAST(row_number() OVER (PARTITION BY e.target_id ORDER BY nullif(n.event_ts, '') DESC NULLS LAST, n.id) AS INT) AS nth
    FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'assoc') e JOIN nodes n ON n.id = e.source_id AND n.node_class = 'event') WHERE nth <= 5"""
)
def events_topk(spark, sf_dir):
    return graph_of(spark, sf_dir).related_events(limit=5)


@query(f"{GRAPH_SQL} SELECT id, source_id, target_id, type FROM edges WHERE (source_id, target_id) IN (('r:0', 'n:0'), ('r:1', 'n:1'), ('r:1', 'n:0'), ('n:1', 'r:1'))")
def adj_edges_between(spark, sf_dir):
    pairs = rows(spark, "source_id string, target_id string", ("r:0", "n:0"), ("r:1", "n:1"), ("r:1", "n:0"), ("n:1", "r:1"))
    return graph_of(spark, sf_dir).edges_between(pairs).select("id", "source_id", "target_id", "type")


@query(f"{GRAPH_SQL} SELECT me, other FROM neighbours")
def adj_neighbours(spark, sf_dir):
    return graph_of(spark, sf_dir).neighbours()


@query(
    f"""{GRAPH_SQL}, deg AS (SELECT me, count(*) AS degree FROM (SELECT me FROM drill UNION ALL SELECT me FROM relations) GROUP BY me)
    SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN deg d ON d.me = n.id"""
)
def view_degrees(spark, sf_dir):
    return graph_of(spark, sf_dir).degrees()


VIEW_SQL = f"{GRAPH_SQL}, deg AS (SELECT me, count(*) AS degree FROM (SELECT me FROM drill UNION ALL SELECT me FROM relations) GROUP BY me)"


@query(f"{VIEW_SQL} SELECT v.me, v.other, d.degree FROM neighbours v JOIN deg d ON d.me = v.other WHERE v.me = 'n:3' AND v.me <> v.other")
def graph_view(spark, sf_dir):
    return graph_of(spark, sf_dir).view(rows(spark, "me string", ("n:3",)))[0]


@query(
    f"""{GRAPH_SQL} SELECT me, 'hierarchy::' || me || '::' || child AS edge_id, child AS other FROM drill WHERE me = 'n:3'
    UNION ALL SELECT me, edge_id, other FROM relations WHERE me = 'n:3'"""
)
def graph_view_edges(spark, sf_dir):
    return graph_of(spark, sf_dir).view(rows(spark, "me string", ("n:3",)))[1]


@query(
    f"""{GRAPH_SQL}, focus AS (SELECT id AS me FROM nodes WHERE hub OR id LIKE 's:%')
    SELECT me, CAST(row_number() OVER (PARTITION BY me ORDER BY seq, id) AS INT) AS pos, id FROM (
    SELECT me, me AS id, -1 AS seq FROM focus UNION ALL
    SELECT v.me, v.other, n.seq FROM neighbours v JOIN focus f ON f.me = v.me JOIN nodes n ON n.id = v.other WHERE v.me <> v.other)"""
)
def node_view(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return g.node_views(g.nodes.where("hub or id like 's:%'").select(F.col("id").alias("me")))


@query(f"{GRAPH_SQL} SELECT e.id FROM edges e JOIN nodes a ON a.id = e.source_id AND a.node_class = 'concept' JOIN nodes b ON b.id = e.target_id AND b.node_class = 'concept'")
def edges_within(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return g.within(g.of_class("concept").select("id")).select("id")


# mutations


def raw_edges(g: Graph) -> DataFrame:
    """All edges in a given order, with reversed and repeated ones, self loops and missing ends."""
    own = g.edges.select("id", "source_id", "target_id", "type", F.lit(1).cast("long").alias("seq"))
    back = g.edges.where("type = 'mutex'").select(F.concat(F.lit("back "), "id").alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type", F.lit(2).cast("long").alias("seq"))
    again = g.edges.where("source_id like 'n:%'").select(F.concat(F.lit("again "), "id").alias("id"), "source_id", "target_id", "type", F.lit(3).cast("long").alias("seq"))
    loops = g.hubs().select(F.concat(F.lit("loop "), "id").alias("id"), F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("assoc").alias("type"), F.lit(4).cast("long").alias("seq"))
    missing = g.hubs().select(F.concat(F.lit("gone "), "id").alias("id"), F.col("id").alias("source_id"), F.lit("x:0").alias("target_id"), F.lit("assoc").alias("type"), F.lit(5).cast("long").alias("seq"))
    wrong = g.edges.where("source_id like 'r:%'").select(F.concat(F.lit("wrong "), "id").alias("id"), "source_id", "target_id", F.lit("mutex").alias("type"), F.lit(6).cast("long").alias("seq"))
    return own.unionAll(back).unionAll(again).unionAll(loops).unionAll(missing).unionAll(wrong)


RAW_SQL = f"""{GRAPH_SQL}, raw AS (SELECT id, source_id, target_id, type, 1 AS seq FROM edges
    UNION ALL SELECT 'back ' || id, target_id, source_id, type, 2 FROM edges WHERE type = 'mutex'
    UNION ALL SELECT 'again ' || id, source_id, target_id, type, 3 FROM edges WHERE source_id LIKE 'n:%'
    UNION ALL SELECT 'loop ' || id, id, id, 'assoc', 4 FROM nodes WHERE hub
    UNION ALL SELECT 'gone ' || id, id, 'x:0', 'assoc', 5 FROM nodes WHERE hub
    UNION ALL SELECT 'wrong ' || id, source_id, target_id, 'mutex', 6 FROM edges WHERE source_id LIKE 'r:%'),
checked AS (SELECT r.*, CASE WHEN r.source_id = r.target_id THEN 'self loop' WHEN a.id IS NULL OR b.id IS NULL THEN 'missing end'
    WHEN r.type = 'mutex' AND (a.node_class <> 'fact' OR b.node_class <> 'fact') THEN 'mutex needs facts' END AS fault
    FROM raw r LEFT JOIN nodes a ON a.id = r.source_id LEFT JOIN nodes b ON b.id = r.target_id)"""


@query(f"{RAW_SQL} SELECT id, fault FROM checked WHERE fault IS NOT NULL")
def edge_validate(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return edge_faults(raw_edges(g), g.nodes).where("fault is not null").select("id", "fault")


@query(
    f"""{RAW_SQL} SELECT id, source_id, target_id, type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY type,
    CASE WHEN type = 'mutex' THEN least(source_id, target_id) ELSE source_id END, CASE WHEN type = 'mutex' THEN greatest(source_id, target_id) ELSE target_id END
    ORDER BY seq, id) AS INT) AS nth FROM checked WHERE fault IS NULL) WHERE nth = 1"""
)
def edge_dedup(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return valid_edges(raw_edges(g), g.nodes).select("id", "source_id", "target_id", "type")


@query(f"{GRAPH_SQL} SELECT id FROM edges WHERE source_id NOT LIKE 'c:%' AND target_id NOT LIKE 'c:%'")
def node_cascade_delete(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return g.without_nodes(g.nodes.where("id like 'c:%'").select("id")).edges.select("id")


@query(f"{GRAPH_SQL} SELECT id, CASE WHEN id LIKE 'c:%' THEN 'changed ' || name ELSE name END AS name FROM nodes UNION ALL SELECT 'new:1', 'new'")
def node_upsert(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    changed = g.nodes.where("id like 'c:%'").withColumns({"name": F.concat(F.lit("changed "), "name"), "seq": F.col("seq") + 1})
    fresh = g.nodes.where("id = 'r:0'").withColumns({"id": F.lit("new:1"), "name": F.lit("new")})
    return g.with_nodes(changed.unionByName(fresh)).nodes.select("id", "name")


@query(f"{GRAPH_SQL} SELECT id, name, CASE WHEN id LIKE 'n:%' THEN 'new content' ELSE content END AS content FROM nodes WHERE node_class = 'concept'")
def node_update(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    changes = g.nodes.where("id like 'n:%'").select("id", F.lit("new content").alias("content"), F.lit(None).cast("string").alias("name"))
    return g.updated_nodes(changes).of_class("concept").select("id", "name", "content")


@query(
    """SELECT id, value FROM (SELECT 'c:' || c_custkey AS id, c_name AS value FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'c:' || c_custkey, c_name || ' v2' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation)"""
)
def changelog_flush(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("value"), "c_custkey")
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("value"))
    step = lambda df, op, value, seq: df.select("id", F.lit(op).alias("op"), value.alias("value"), F.lit(seq).alias("seq"))
    log = step(c.where("c_custkey % 3 = 1"), "delete", F.col("value"), 1).unionAll(step(c.where("c_custkey % 3 = 1"), "upsert", F.concat("value", F.lit(" v2")), 2))
    log = log.unionAll(step(c.where("c_custkey % 3 = 2"), "upsert", F.col("value"), 1)).unionAll(step(c.where("c_custkey % 3 = 2"), "delete", F.col("value"), 3)).unionAll(step(n, "upsert", F.col("value"), 1))
    return ingest.flush(c.select("id", "value"), log)


@query("SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS value FROM nation")
def meta_upsert(spark, sf_dir):
    meta = read(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"), "n_nationkey")
    return store.write_meta(meta.select("key", "value"), meta.where("n_nationkey < 5").select("key", F.lit("new").alias("value")))


# token costs and rendering


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def tok_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.estimate(F.col("text")).cast("long").alias("tokens"))


MIXED = [
    ("深度学习 abc", "plain"), ("深度，学习。x?", "full-width signs"), ("图谱记忆是一种结构", "only CJK"), ("a,b;c 图 d", "single"), ("", "empty"), ("。！", "signs only"), ("graph 图谱 memory 记忆 graph", "alternating")
]
MIXED_SQL = "(VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in MIXED) + ") m(text, kind)"


@query(f"SELECT kind, CAST({tokens_sql('text')} AS BIGINT) AS tokens, array_to_string({words_sql('text')}, '|') AS words, array_to_string(list_sort({set_sql('text')}), '|') AS distinct_words FROM {MIXED_SQL}")
def tok_mixed_scripts(spark, sf_dir):
    text = F.col("text")
    return rows(spark, "text string, kind string", *MIXED).select(
        "kind", tx.estimate(text).cast("long").alias("tokens"), F.array_join(tx.tokens(text), "|").alias("words"), F.array_join(F.array_sort(tx.token_set(text)), "|").alias("distinct_words")
    )


@query(f"{GRAPH_SQL} SELECT id, {node_sql()} AS line FROM nodes")
def render_node(spark, sf_dir):
    nodes = graph_of(spark, sf_dir).nodes
    return nodes.select("id", budget.rendered(nodes).alias("line"))


@query(f"{GRAPH_SQL} SELECT id, {node_sql(full=False)} AS line FROM nodes")
def render_node_short(spark, sf_dir):
    nodes = graph_of(spark, sf_dir).nodes
    return nodes.select("id", budget.rendered(nodes, focus=False).alias("line"))


@query(
    f"""{GRAPH_SQL}, mine AS (SELECT d.me, n.* FROM drill d JOIN nodes n ON n.id = d.child WHERE d.me LIKE 'r:%'),
    numbered AS (SELECT me, 0 AS kind, seq AS pos, substr({node_sql()}, 2) AS line FROM mine UNION ALL
    SELECT e.source_id, 1, b.seq, ' ' || a.name || ' — ' || b.name FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.source_id LIKE 'r:%'),
    lines AS (SELECT me, CAST(row_number() OVER (PARTITION BY me ORDER BY kind, pos) AS INT) AS number, line FROM numbered)
    SELECT me, string_agg(number || '.' || line, chr(10) ORDER BY number) AS text FROM lines GROUP BY me"""
)
def render_facts(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    mine = g.drill_down().where("me like 'r:%'").join(g.nodes, F.col("child") == F.col("id")).withColumn("pos", F.col("seq"))
    edges = g.edges.where("source_id like 'r:%'").join(g.nodes.select(F.col("id").alias("target_id"), F.col("seq").alias("pos")), "target_id")
    return budget.render_facts(mine, edges.withColumn("me", F.col("source_id")), g.nodes, ["me"])


@query(f"{GRAPH_SQL}, {COSTS_SQL} SELECT id, tokens FROM costs")
def node_cost(spark, sf_dir):
    return budget.node_costs(graph_of(spark, sf_dir).nodes).select("id", F.col("tokens").cast("long").alias("tokens"))


EDGE_COSTS_SQL = f"""edge_lines AS (SELECT e.id, e.source_id, e.target_id, coalesce(a.name, e.source_id) || ' — ' || coalesce(b.name, e.target_id) AS line
    FROM edges e LEFT JOIN nodes a ON a.id = e.source_id LEFT JOIN nodes b ON b.id = e.target_id),
edge_costs AS (SELECT id, source_id, target_id, {tokens_sql("line")} AS tokens FROM edge_lines)"""


@query(f"{GRAPH_SQL}, {EDGE_COSTS_SQL} SELECT id, tokens FROM edge_costs")
def edge_cost(spark, sf_dir):
    return budget.edge_costs(graph_of(spark, sf_dir)).select("id", F.col("tokens").cast("long").alias("tokens"))


@query(
    f"""{GRAPH_SQL}, {COSTS_SQL}, {EDGE_COSTS_SQL} SELECT p.id, CAST(sum(p.tokens) AS BIGINT) AS tokens FROM (
    SELECT id, tokens FROM costs UNION ALL SELECT d.me, c.tokens FROM drill d JOIN costs c ON c.id = d.child
    UNION ALL SELECT source_id, tokens FROM edge_costs UNION ALL SELECT target_id, tokens FROM edge_costs) p JOIN nodes n ON n.id = p.id GROUP BY p.id"""
)
def active_view_cost(spark, sf_dir):
    return budget.active_view_costs(graph_of(spark, sf_dir))


HIERARCHY_SQL = f"""{GRAPH_SQL}, {COSTS_SQL}, hierarchy AS (SELECT c.id, coalesce(b.members, 0) AS members, CAST(c.tokens + coalesce(b.below, 0) AS BIGINT) AS tokens
    FROM costs c LEFT JOIN (SELECT d.me, count(*) AS members, sum(k.tokens) AS below FROM drill d JOIN costs k ON k.id = d.child GROUP BY d.me) b ON b.me = c.id)"""


@query(f"{HIERARCHY_SQL} SELECT id, members, tokens FROM hierarchy")
def guard_sum(spark, sf_dir):
    return budget.hierarchy_costs(graph_of(spark, sf_dir))


@query(f"{HIERARCHY_SQL} SELECT id, members, tokens FROM hierarchy WHERE tokens > 150")
def budget_violations(spark, sf_dir):
    return budget.over_budget(graph_of(spark, sf_dir), 150)


@query(
    f"""{GRAPH_SQL}, lens AS (SELECT n.id, length({node_sql("n.")}) AS own, coalesce(m.members, 0) AS members, coalesce(m.below, 0) AS below FROM nodes n LEFT JOIN
    (SELECT d.me, count(*) AS members, sum(length({node_sql("k.", False)})) AS below FROM drill d JOIN nodes k ON k.id = d.child GROUP BY d.me) m ON m.me = n.id)
    SELECT id, members, CAST(greatest(1, (own + below + members) // 3) AS BIGINT) AS tokens FROM lens"""
)
def guard_rendered(spark, sf_dir):
    return budget.neighbourhood_costs(graph_of(spark, sf_dir)).select("id", "members", F.col("tokens").cast("long").alias("tokens"))


@query(f"{GRAPH_SQL}, {COSTS_SQL} SELECT n.node_class, CAST(sum(c.tokens) AS BIGINT) AS tokens, sum(c.tokens) <= 100000 AS fits FROM nodes n JOIN costs c ON c.id = n.id GROUP BY n.node_class")
def fits_budget(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return budget.fits(g.nodes.join(budget.node_costs(g.nodes), "id"), ["node_class"], "tokens", 100_000)


@query(
    f"""{GRAPH_SQL}, {COSTS_SQL} SELECT me, id, running FROM (SELECT d.me, n.id, CAST(sum(c.tokens) OVER w AS BIGINT) AS running, row_number() OVER w AS nth
    FROM drill d JOIN nodes n ON n.id = d.child JOIN costs c ON c.id = n.id
    WINDOW w AS (PARTITION BY d.me ORDER BY n.seq ROWS UNBOUNDED PRECEDING)) WHERE running <= 100 OR nth = 1"""
)
def trim_prefix(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    members = g.drill_down().join(g.nodes.select("id", "seq"), F.col("child") == F.col("id")).join(budget.node_costs(g.nodes), "id")
    return budget.trim_prefix(members, ["me"], "seq", "tokens", 100).select("me", "id", "running")


@query(
    f"""{GRAPH_SQL}, newest AS (SELECT id, name, content, event_ts, row_number() OVER (ORDER BY nullif(event_ts, '') DESC NULLS LAST, id DESC) AS pos FROM nodes WHERE node_class = 'event'),
    lines AS (SELECT pos, id, pos || '. [id:' || id || ']' || CASE WHEN coalesce(event_ts, '') <> '' THEN '（' || event_ts || '）' ELSE '' END || ' ' || name
      || CASE WHEN trim(content) <> '' AND trim(content) <> name THEN ' — ' || trim(content) ELSE '' END AS line FROM newest WHERE pos <= 40),
    sums AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY pos) + {len(tx.RECALL_HEADER)} AS len FROM lines),
    kept AS (SELECT pos, id, line, CAST(greatest(1, trunc(11 * 1.7 + (len - 11) // 3)) AS BIGINT) AS tokens FROM sums)
    SELECT pos, id, line, tokens FROM kept WHERE tokens <= 600 OR pos = 1"""
)
def recall_events(spark, sf_dir):
    found = budget.recall_events(graph_of(spark, sf_dir).of_class("event"), 40, 600)
    return found.select(F.col("pos").cast("long").alias("pos"), "id", "line", F.col("tokens").cast("long").alias("tokens"))


@query(
    f"""SELECT round(avg(e / t), 6) AS mean_ratio, round(100.0 * count(*) FILTER (e < t) / count(*), 6) AS under_pct, round(max(CASE WHEN e < t THEN t / e END), 6) AS max_under_ratio
    FROM (SELECT CAST({tokens_sql("text")} AS DOUBLE) AS e, CAST(len({words_sql("text")}) AS DOUBLE) AS t FROM documents) WHERE t > 0"""
)
def estimator_eval(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return budget.estimator_report(docs.select(tx.estimate(F.col("text")).alias("estimate"), F.size(tx.tokens(F.col("text"))).alias("true_count")))


# words, postings, entries


@query(f"SELECT item_id, pos - 1 AS pos, words[pos] AS token FROM (SELECT item_id, words, unnest(range(1, len(words) + 1)) AS pos FROM (SELECT item_id, {words_sql('text')} AS words FROM benchmark))")
def tok_tokenize(spark, sf_dir):
    rows_ = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    return rows_.withColumn("pos", F.col("pos").cast("long"))


POSTINGS_SQL = f"{GRAPH_SQL}, postings AS (SELECT DISTINCT id, unnest(list_concat([name], {words_sql('name')})) AS term FROM nodes WHERE name <> '')"


@query(f"{POSTINGS_SQL} SELECT term, id FROM postings")
def alias_postings(spark, sf_dir):
    return search.postings(graph_of(spark, sf_dir).nodes).select("term", "id")


LOOKUP_SQL = f"""{POSTINGS_SQL}, asked AS (SELECT n_nationkey AS query_id, {words_sql("n_name || ' and ' || n_nationkey")} AS words FROM nation),
terms AS (SELECT query_id, words[i] AS term, i - 1 AS pos FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM asked)),
hits AS (SELECT t.query_id, p.id, min(t.pos) AS pos FROM terms t JOIN postings p ON p.term = t.term GROUP BY t.query_id, p.id)"""


def nation_hits(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    text = F.concat("n_name", F.lit(" and "), F.col("n_nationkey").cast("string"))
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("query"))
    return search.lookup(asked, search.postings(g.nodes))


@query(f"{LOOKUP_SQL} SELECT query_id, id, pos FROM hits")
def alias_lookup(spark, sf_dir):
    return nation_hits(spark, sf_dir, graph_of(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""{GRAPH_SQL}, called AS (SELECT id, CASE WHEN c_custkey IS NULL THEN name ELSE name || ' of ' || c_nationkey END AS name FROM nodes LEFT JOIN customer ON id = 'c:' || c_custkey WHERE id NOT LIKE 's:%'
      UNION ALL SELECT 'p:' || p_partkey, 'lot ' || (p_partkey % 25) FROM part),
    postings AS (SELECT DISTINCT id, unnest(list_concat([name], {words_sql('name')})) AS term FROM called WHERE name <> ''),
    asked AS (SELECT n_nationkey AS query_id, {words_sql("n_name || ' and ' || n_nationkey")} AS words FROM nation),
    terms AS (SELECT query_id, words[i] AS term, i - 1 AS pos FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM asked))
    SELECT t.query_id, p.id, min(t.pos) AS pos FROM terms t JOIN postings p ON p.term = t.term GROUP BY t.query_id, p.id"""
)
def kept_index_lookup(spark, sf_dir):
    """Lookups in a kept index after three updates: customers are called otherwise, parts get an alias, suppliers go."""
    nodes = graph_of(spark, sf_dir).nodes
    number = lambda column: F.col(column).cast("string")
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), number("c_custkey")).alias("id"), F.concat("c_name", F.lit(" of "), number("c_nationkey")).alias("name"))
    lot = F.concat(F.lit("lot "), (F.col("p_partkey") % 25).cast("string"))
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("p:"), number("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.array(lot).alias("aliases"))
    index = TermIndex.build(nodes, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index = index.updated(customer).updated(part).updated(gone=nodes.where("id like 's:%'"))
    text = F.concat("n_name", F.lit(" and "), number("n_nationkey"))
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("query"))
    return index.lookup(asked).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""{LOOKUP_SQL}, entries AS (SELECT query_id, id, 100 AS priority, pos FROM hits UNION ALL
    SELECT q.n_nationkey, n.id, 0, n.seq FROM nation q JOIN nodes n ON n.id = 'r:' || q.n_regionkey OR n.id = 'n:' || q.n_nationkey),
    once AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, id ORDER BY priority DESC, pos) AS INT) AS nth FROM entries)
    SELECT query_id, id, priority, CAST(row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, pos, id) AS INT) AS place FROM once WHERE nth = 1"""
)
def entry_merge(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    named = nation_hits(spark, sf_dir, g).select("query_id", "id", F.lit(100).alias("priority"), F.lit(False).alias("exclusive"), F.col("pos").cast("long").alias("pos"))
    nation = read(spark, sf_dir, "nation")
    near = nation.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")))).alias("id"))
    hubs = near.join(g.nodes.select("id", F.col("seq").alias("pos")), "id").select("query_id", "id", F.lit(0).alias("priority"), F.lit(False).alias("exclusive"), "pos")
    return search.merge_entries(named.unionByName(hubs))


# going down from a root

_SCORE = "(2 * len(list_intersect(q.words, {n})) + len(list_intersect(q.words, {c}))) / len(q.words)"


def _level_sql(level: int, edges: str, left: str) -> str:
    """The choice at a level: what is below the last one, by words shared with the query, within the places that are left."""
    score = _SCORE.format(n=set_sql("n.name"), c=set_sql("n.content"))
    return f"""c{level} AS (SELECT DISTINCT q.query_id, n.id, n.seq, {score} AS score FROM {edges} JOIN nodes n ON n.id = e.target_id),
    l{level} AS (SELECT * FROM (SELECT query_id, id, {level} AS level, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS INT) AS place FROM c{level} WHERE score > 0)
      WHERE place <= 10 - {left})"""


DESCENT_SQL = f"""{GRAPH_SQL}, asked AS (SELECT n_nationkey AS query_id, r_name || ' ' || n_name || ' ' || (SELECT min(c_mktsegment) FROM customer) AS query FROM nation JOIN region ON r_regionkey = n_regionkey
      UNION ALL SELECT 1000 + n_nationkey, 'x' || n_nationkey FROM nation),
    q AS (SELECT query_id, {set_sql("query")} AS words FROM asked),
    {_level_sql(1, "q JOIN (SELECT id AS target_id FROM nodes WHERE id LIKE 'r:%') e ON true", "0")},
    {_level_sql(2, "q JOIN l1 l ON l.query_id = q.query_id JOIN edges e ON e.source_id = l.id AND e.type = 'assoc'", "(SELECT count(*) FROM l1 WHERE l1.query_id = c2_.query_id)").replace("FROM c2 WHERE score > 0)", "FROM c2 WHERE score > 0) c2_")},
    {_level_sql(3, "q JOIN l2 l ON l.query_id = q.query_id JOIN edges e ON e.source_id = l.id AND e.type = 'assoc'", "(SELECT count(*) FROM (SELECT query_id FROM l1 UNION ALL SELECT query_id FROM l2) u WHERE u.query_id = c3_.query_id)").replace("FROM c3 WHERE score > 0)", "FROM c3 WHERE score > 0) c3_")}"""


@query(
    f"""{DESCENT_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, id, level, place FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) UNION ALL
    SELECT CAST(q.query_id AS BIGINT), n.id, 0, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY n.seq) AS INT) FROM q JOIN nodes n ON n.id LIKE 'r:%' WHERE q.query_id NOT IN (SELECT query_id FROM l1)"""
)
def root_descent(spark, sf_dir):
    """From a root above the regions down to nations and customers, by words; queries that match no region get the regions."""
    g = graph_of(spark, sf_dir)
    root = g.nodes.where("id = 'r:0'").withColumns({"id": F.lit(ROOT), "name": F.lit(ROOT), "content": F.lit("")})
    hung = g.nodes.where("id like 'r:%'").select(F.concat(F.lit(f"{ROOT}>"), "id").alias("id"), F.lit(ROOT).alias("source_id"), F.col("id").alias("target_id"), F.lit("assoc").alias("type"), F.lit(0.0).alias("priority"))
    segment = read(spark, sf_dir, "customer").agg(F.min("c_mktsegment").alias("segment"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(segment, F.lit(True))
    asked = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat_ws(" ", "r_name", "n_name", "segment").alias("query"))
    lost = n.select((F.col("n_nationkey") + 1000).cast("long").alias("query_id"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("query"))
    return descend.descend(Graph(g.nodes.unionByName(root), g.edges.unionByName(hung.select(g.edges.columns))), asked.unionByName(lost))


# traversal


@query(
    f"""{GRAPH_SQL}, pairs AS (SELECT 'c:' || c_custkey AS source, 'c:' || (c_custkey + 1) AS target FROM customer WHERE c_custkey % 20 = 0 UNION ALL
      SELECT 'e:' || event_id, 's:1' FROM events WHERE event_id % 2000 = 0 UNION ALL SELECT 'n:' || n_nationkey, 'n:' || n_nationkey FROM nation WHERE n_nationkey % 20 = 0),
    walk AS (SELECT DISTINCT source, source AS at, 0 AS hop, [source] AS path FROM pairs JOIN nodes ON id = source
      UNION ALL SELECT w.source, n.other, w.hop + 1, min(list_append(w.path, n.other)) FROM walk w JOIN neighbours n ON n.me = w.at WHERE w.hop < 6 GROUP BY w.source, n.other, w.hop)
    SELECT p.source, p.target, CAST(min(hop) AS BIGINT) AS hops, array_to_string(arg_min(w.path, hop), '>') AS path
    FROM pairs p JOIN walk w ON w.source = p.source AND w.at = p.target GROUP BY p.source, p.target"""
)
def shortest_path(spark, sf_dir):
    """From customers to the next ones, from events to a supplier that nothing reaches, and from nations to themselves."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 20 = 0").withColumn("next", F.col("c_custkey") + 1)
    pairs = c.select(named("c:", "c_custkey").alias("source"), named("c:", "next").alias("target"))
    pairs = pairs.unionByName(read(spark, sf_dir, "events").where("event_id % 2000 = 0").select(named("e:", "event_id").alias("source"), F.lit("s:1").alias("target")))
    n = read(spark, sf_dir, "nation").where("n_nationkey % 20 = 0").select(named("n:", "n_nationkey").alias("source"))
    found = iterate.shortest_paths(graph_of(spark, sf_dir), pairs.unionByName(n.withColumn("target", F.col("source"))))
    return found.select("source", "target", (F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path"))


@query(
    f"""{GRAPH_SQL}, {COSTS_SQL}, tree AS (SELECT id AS me, id, CAST(NULL AS VARCHAR) AS via, 0 AS depth, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM nodes WHERE id LIKE 'r:%'
      UNION ALL SELECT e.source_id, n.id, e.id, 1, n.seq, 0, 0 FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id LIKE 'r:%'
      UNION ALL SELECT r.source_id, n.id, e.id, 2, m.seq, n.seq, 0 FROM edges r JOIN nodes m ON m.id = r.target_id JOIN edges e ON e.source_id = m.id JOIN nodes n ON n.id = e.target_id WHERE r.source_id LIKE 'r:%'
      UNION ALL SELECT r.source_id, n.id, e.id, 3, m.seq, k.seq, n.seq FROM edges r JOIN nodes m ON m.id = r.target_id JOIN edges f ON f.source_id = m.id JOIN nodes k ON k.id = f.target_id
        JOIN edges e ON e.source_id = k.id AND e.type = 'assoc' JOIN nodes n ON n.id = e.target_id WHERE r.source_id LIKE 'r:%'),
    summed AS (SELECT t.me, t.id, t.via, row_number() OVER w AS pos, sum(k.tokens) OVER w AS used FROM tree t JOIN costs k ON k.id = t.id WINDOW w AS (PARTITION BY t.me ORDER BY depth, a, b, c ROWS UNBOUNDED PRECEDING))
    SELECT me, CAST(pos AS BIGINT) AS pos, id, via FROM summed WHERE used <= 2000"""
)
def subgraph_budget(spark, sf_dir):
    """From regions over nations and customers to orders, where the budget ends; the SQL follows that tree."""
    g = graph_of(spark, sf_dir)
    return iterate.subgraphs(g, g.nodes.where("id like 'r:%'").select(F.col("id").alias("me")), 2000)


@query(
    f"""{GRAPH_SQL}, {COSTS_SQL}, views AS (SELECT d.me, n.seq AS pos, c.tokens, row_number() OVER (PARTITION BY d.me ORDER BY n.seq) AS nth
      FROM drill d JOIN nodes n ON n.id = d.child JOIN costs c ON c.id = n.id),
    packed AS (SELECT me, pos, tokens, nth, 0 AS batch, tokens AS used FROM views WHERE nth = 1 UNION ALL
      SELECT v.me, v.pos, v.tokens, v.nth, CASE WHEN p.used + v.tokens <= 60 THEN p.batch ELSE p.batch + 1 END,
        CASE WHEN p.used + v.tokens <= 60 THEN p.used + v.tokens ELSE v.tokens END FROM packed p JOIN views v ON v.me = p.me AND v.nth = p.nth + 1)
    SELECT me, pos, CAST(tokens AS INT) AS tokens, batch FROM packed"""
)
def layer_pack(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    views = g.drill_down().join(budget.node_costs(g.nodes), F.col("child") == F.col("id")).join(g.nodes.select("id", "seq"), "id")
    return iterate.pack_layer(views.select("me", F.col("seq").alias("pos"), "tokens"), ["me"], 60)


@query(
    f"""{GRAPH_SQL}, members AS (SELECT 'b' || (e.target_id = 'c:1') AS batch, n.seq AS pos, e.source_id AS id FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.source_id LIKE 'e:%'
      UNION ALL SELECT 'bfalse', 0, target_id FROM edges WHERE source_id LIKE 'e:%')
    SELECT batch, id, min(pos) AS pos, CAST(row_number() OVER (PARTITION BY batch ORDER BY min(pos), id) AS INT) AS number FROM members GROUP BY batch, id"""
)
def batch_merge(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    events = g.edges.where("source_id like 'e:%'")
    batch = F.concat(F.lit("b"), (F.col("target_id") == "c:1").cast("string"))
    members = events.join(g.nodes.select(F.col("id").alias("source_id"), F.col("seq").alias("pos")), "source_id").select(batch.alias("batch"), "pos", F.col("source_id").alias("id"))
    return iterate.merge_batch(members.unionAll(events.select(F.lit("bfalse").alias("batch"), F.lit(0).cast("long").alias("pos"), F.col("target_id").alias("id"))))


@query()
def traverse_lexical(spark, sf_dir):
    """Every twentieth customer is a query of its own, with the limits that the operator has by default."""
    customers = read(spark, sf_dir, "customer").where("c_custkey % 20 = 0")
    seeds = customers.select(F.col("c_custkey").alias("query_id"), F.lit("BUILDING nation order").alias("query"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return iterate.traverse(graph_of(spark, sf_dir), seeds).nodes.select("query_id", "round", "place", "id")


# diagnostics

CROSS_SQL = f"""{GRAPH_SQL}, crossing AS (SELECT e.*, a.doc_id AS source_doc, b.doc_id AS target_doc, coalesce(a.doc_id <> b.doc_id, false) AS crosses
    FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id),
deg AS (SELECT n.id, count(x.id) AS degree FROM nodes n LEFT JOIN (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x ON x.id = n.id GROUP BY n.id)"""


@query(
    f"""{CROSS_SQL} SELECT n AS nodes, e AS edges, round(2 * e / n, 6) AS avg_degree, i AS isolated, round(i / n, 6) AS isolated_rate, c AS cross_doc_edges, round(c / e, 6) AS cross_doc_rate
    FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM crossing) AS e, (SELECT count(*) FROM deg WHERE degree = 0) AS i, (SELECT count(*) FROM crossing WHERE crosses) AS c)"""
)
def graph_quality(spark, sf_dir):
    return quality.graph_quality(graph_of(spark, sf_dir))


@query(f"{GRAPH_SQL} SELECT node_class, count(*) AS n FROM nodes GROUP BY node_class")
def class_distribution(spark, sf_dir):
    return quality.class_counts(graph_of(spark, sf_dir))


@query(f"{CROSS_SQL} SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def structure_degree(spark, sf_dir):
    return quality.degree_histogram(graph_of(spark, sf_dir))


@query(f"{CROSS_SQL} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10")
def structure_top_nodes(spark, sf_dir):
    return quality.top_degrees(graph_of(spark, sf_dir))


@query(f"{CROSS_SQL} SELECT least(source_doc, target_doc) AS doc_a, greatest(source_doc, target_doc) AS doc_b, count(*) AS n FROM crossing WHERE crosses GROUP BY 1, 2 ORDER BY n DESC, doc_a, doc_b LIMIT 10")
def structure_docpairs(spark, sf_dir):
    return quality.top_doc_pairs(graph_of(spark, sf_dir))


@query(
    f"""{CROSS_SQL} SELECT count(*) FILTER (crosses) AS with_cross, count(*) FILTER (NOT crosses) AS only_same FROM
    (SELECT id, bool_or(crosses) AS crosses FROM (SELECT source_id AS id, crosses FROM crossing UNION ALL SELECT target_id, crosses FROM crossing) GROUP BY id)"""
)
def structure_crossing(spark, sf_dir):
    return quality.crossing_nodes(graph_of(spark, sf_dir))


@query(
    f"""{HIERARCHY_SQL} SELECT 'class ' || node_class AS check, count(*) AS n FROM nodes GROUP BY node_class UNION ALL SELECT 'type ' || type, count(*) FROM edges GROUP BY type
    UNION ALL SELECT 'over budget', count(*) FROM hierarchy WHERE tokens > 900 UNION ALL SELECT 'repeated pairs', count(*) FROM
    (SELECT 1 FROM edges WHERE type = 'assoc' GROUP BY source_id, target_id HAVING count(*) > 1)""".replace("AS check", 'AS "check"')
)
def health_check(spark, sf_dir):
    return quality.health(graph_of(spark, sf_dir), 900)


# Nodes hang from regions, and only parts join what hangs from several of them: labels need to run over such roots only.
ROOTS_SQL = """nation_root AS (SELECT n_nationkey AS key, coalesce('r:' || r_regionkey, 'n:' || n_nationkey) AS root FROM nation LEFT JOIN region ON r_regionkey = n_regionkey),
customer_root AS (SELECT c_custkey AS key, coalesce(root, 'c:' || c_custkey) AS root FROM customer LEFT JOIN nation_root ON key = c_nationkey),
order_root AS (SELECT o_orderkey AS key, coalesce(root, 'o:' || o_orderkey) AS root FROM orders LEFT JOIN customer_root ON key = o_custkey),
met AS (SELECT DISTINCT p_partkey AS key, root FROM lineitem JOIN order_root ON key = l_orderkey JOIN part ON p_partkey = l_partkey),
part_root AS (SELECT p_partkey AS key, coalesce(root, 'p:' || p_partkey) AS root FROM part LEFT JOIN (SELECT key, min(root) AS root FROM met GROUP BY key) ON key = p_partkey),
roots AS (SELECT 'r:' || r_regionkey AS root FROM region UNION ALL SELECT root FROM nation_root UNION ALL SELECT root FROM customer_root UNION ALL SELECT root FROM order_root
  UNION ALL SELECT root FROM part_root UNION ALL SELECT 's:' || s_suppkey FROM supplier
  UNION ALL SELECT coalesce(root, 'e:' || event_id) FROM events LEFT JOIN customer_root ON key = user_id
  UNION ALL SELECT coalesce(root, 'd:' || doc_id) FROM documents LEFT JOIN part_root ON key = doc_id),
bridges AS (SELECT DISTINCT a.root AS a, b.root AS b FROM part_root a JOIN met b ON a.key = b.key WHERE a.root <> b.root),
sides AS (SELECT a, b FROM bridges UNION SELECT b, a FROM bridges)"""


@query(
    f"""WITH RECURSIVE {ROOTS_SQL}, reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
    least AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
    sizes AS (SELECT coalesce(component, root) AS component, count(*) AS n FROM roots LEFT JOIN least ON a = root GROUP BY ALL)
    SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM sizes"""
)
def components(spark, sf_dir):
    return quality.component_summary(iterate.weak_components(graph_of(spark, sf_dir)))


@query(
    f"""{GRAPH_SQL}, two AS (SELECT 'nodes' AS metric, CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS "before", CAST((SELECT count(*) FROM nodes WHERE id NOT LIKE 'e:%') AS DOUBLE) AS "after" UNION ALL
    SELECT 'edges', (SELECT count(*) FROM edges), (SELECT count(*) FROM edges WHERE source_id NOT LIKE 'e:%'))
    SELECT metric, "before", "after", round("after" - "before", 6) AS delta, round(100 * ("after" - "before") / "before", 6) AS pct FROM two"""
)
def report_delta(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    without = g.without_nodes(g.of_class("event").select("id"))
    return quality.report_delta(*(quality.graph_size(x) for x in (g, without)))


# ranking

PAIRS_SQL = f"""q AS (SELECT item_id AS query_id, {set_sql("text")} AS words FROM benchmark), d AS (SELECT doc_id AS id, {set_sql("text")} AS words FROM documents),
scored AS (SELECT q.query_id, d.id, len(list_intersect(q.words, d.words)) / len(q.words) AS score FROM q, d WHERE len(q.words) > 0 AND len(list_intersect(q.words, d.words)) > 0),
ranked AS (SELECT query_id, id AS doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored),
gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def searched(spark: SparkSession, sf_dir: str, top: int | None = None) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = rank.lexical_search(queries, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rank.rerank(found.withColumn("pos", F.col("id")), top).withColumnRenamed("id", "doc_id")


def gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return rank.passage_docs(queries, read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def lexical_search(spark, sf_dir):
    return searched(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def lexical_best(spark, sf_dir):
    """What ``lexical_search`` gives, by bounds instead of all pairs."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = rank.best_texts(queries, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_passages(spark, sf_dir):
    return gold_docs(spark, sf_dir)


@query(
    f"""WITH {PAIRS_SQL}, types AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'inference_query' WHEN 1 THEN 'comparison_query' ELSE 'temporal_query' END AS type FROM benchmark
      WHERE item_id IN (SELECT query_id FROM gold)),
    sizes AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
    hits AS (SELECT r.query_id, r.rank, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS INT) AS nth FROM ranked r JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id),
    per AS (SELECT t.query_id, t.type, s.n AS gold, """
    + ", ".join(
        f"count(*) FILTER (h.rank <= {k}) AS n{k}, coalesce(sum(h.nth / h.rank) FILTER (h.rank <= {k}), 0) AS p{k}, coalesce(max(1 / h.rank) FILTER (h.rank <= {k}), 0) AS r{k}" for k in (2, 4, 10)
    )
    + """ FROM types t JOIN sizes s ON s.query_id = t.query_id LEFT JOIN hits h ON h.query_id = t.query_id GROUP BY t.query_id, t.type, s.n)
    SELECT coalesce(type, 'overall') AS type, count(*) AS n, """
    + ", ".join(
        f"round(avg(CASE WHEN n{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}, round(avg(n{k} / gold), 6) AS recall_{k}, round(avg(p{k} / least(gold, {k})), 6) AS map_{k}, round(avg(r{k}), 6) AS mrr_{k}"
        for k in (2, 4, 10)
    )
    + " FROM per GROUP BY GROUPING SETS ((type), ())"
)
def retrieval_metrics(spark, sf_dir):
    gold = cut(gold_docs(spark, sf_dir))
    kinds = F.when(F.col("item_id") % 3 == 0, "inference_query").when(F.col("item_id") % 3 == 1, "comparison_query").otherwise("temporal_query")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), kinds.alias("type")).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return rank.retrieval_metrics(searched(spark, sf_dir), gold, queries)


@query(
    f"""WITH {PAIRS_SQL}, per AS (SELECT g.query_id, count(*) AS gold, count(r.rank) AS found, count(*) FILTER (r.rank <= 10) AS ten FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY g.query_id)
    SELECT count(*) AS n, round(avg(CAST(found > 0 AS INT)), 6) AS reached, round(avg(found / gold), 6) AS recall_any, round(avg(CAST(ten > 0 AS INT)), 6) AS hit_10, round(avg(ten / gold), 6) AS recall_10 FROM per"""
)
def recall_rank_loss(spark, sf_dir):
    return rank.rank_loss(searched(spark, sf_dir), gold_docs(spark, sf_dir))


@query(
    f"""WITH {PAIRS_SQL} SELECT g.query_id, g.doc_id, r.rank, CASE WHEN r.rank IS NULL THEN 'miss' WHEN r.rank <= 10 THEN 'top10' WHEN r.rank <= 50 THEN '11-50' WHEN r.rank <= 100 THEN '51-100' ELSE '100+' END AS bucket
    FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id"""
)
def gold_rank_buckets(spark, sf_dir):
    return rank.gold_ranks(searched(spark, sf_dir), gold_docs(spark, sf_dir))


@query(
    f"""WITH {PAIRS_SQL} SELECT g.query_id, count(*) AS gold, count(r.rank) AS found, count(r.rank) > 0 AS reached, round(count(r.rank) / count(*), 6) AS recall
    FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY g.query_id"""
)
def reached_rate(spark, sf_dir):
    return rank.reached(searched(spark, sf_dir), gold_docs(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


NODE_RANK_SQL = f"""{GRAPH_SQL}, ask AS (SELECT {set_sql("'steel copper order Brand#11 and the BUILDING'")} AS words),
node_scores AS (SELECT id, seq, (2 * len(list_intersect(ask.words, {set_sql("name")})) + len(list_intersect(ask.words, {set_sql("content")}))) / len(ask.words) AS score FROM nodes, ask WHERE node_class IN ('concept', 'fact'))"""


def node_candidates(g: Graph) -> DataFrame:
    core = g.nodes.where(is_core(F.col("node_class")))
    return core.select(F.lit(0).alias("query_id"), F.lit("steel copper order Brand#11 and the BUILDING").alias("query"), "id", "name", "content", F.col("seq").alias("pos"))


@query(f"{NODE_RANK_SQL} SELECT id, round(score, 6) AS score FROM node_scores")
def lexical_score(spark, sf_dir):
    return rank.lexical_scores(node_candidates(graph_of(spark, sf_dir))).select("id", F.round("score", 6).alias("score"))


@query(f"{NODE_RANK_SQL} SELECT id, rank FROM (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, seq) AS INT) AS rank FROM node_scores WHERE score >= 0.2) WHERE rank <= 50")
def rerank_topn(spark, sf_dir):
    return rank.rerank(rank.lexical_scores(node_candidates(graph_of(spark, sf_dir))), 50, 0.2).select("id", "rank")


def parts_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lit(0).alias("query_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("content"), F.array("p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("sources"))


PART_DOCS_SQL = """found AS (SELECT p_partkey AS pos, k, p_name || ' ' || p_type AS body, CASE k WHEN 0 THEN p_brand ELSE 'size ' || p_size END AS doc_id FROM part, (VALUES (0), (1)) a(k)),
part_docs AS (SELECT doc_id, string_agg(body, ' ' ORDER BY pos, k) AS body, min(pos * 10 + k) AS first FROM found GROUP BY doc_id)"""


@query(f"WITH {PART_DOCS_SQL} SELECT doc_id, body, first // 10 AS first_pos, first % 10 AS first_at FROM part_docs")
def docs_from_nodes(spark, sf_dir):
    return rank.docs_from_nodes(parts_as_nodes(spark, sf_dir)).select("doc_id", "body", "first_pos", F.col("first_at").cast("long").alias("first_at"))


@query(f"WITH {PART_DOCS_SQL} SELECT doc_id, CAST(row_number() OVER (ORDER BY first) AS INT) AS rank FROM part_docs")
def ranked_docs(spark, sf_dir):
    return rank.ranked_docs(parts_as_nodes(spark, sf_dir)).select("doc_id", "rank")


@query(
    f"""WITH {PART_DOCS_SQL}, ask AS (SELECT {set_sql("'what is the size 11 of STEEL'")} AS words)
    SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank FROM
    (SELECT doc_id, first, (2 * len(list_intersect(words, {set_sql("doc_id")})) + len(list_intersect(words, {set_sql("body")}))) / len(words) AS score FROM part_docs, ask)"""
)
def doc_rerank(spark, sf_dir):
    ask = rows(spark, "query_id int, query string", (0, "what is the size 11 of STEEL"))
    return rank.doc_rerank(ask, parts_as_nodes(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {PART_DOCS_SQL}, ask AS (SELECT {set_sql("'copper or linen of size Brand#11'")} AS words), base AS (SELECT doc_id, row_number() OVER (ORDER BY first) AS rank FROM part_docs),
    other AS (SELECT p_brand AS doc_id, p_brand || ' ' || min(p_name) || ' ' || max(p_name) AS body FROM part GROUP BY p_brand),
    scores AS (SELECT b.doc_id, b.rank, coalesce((2 * len(list_intersect(words, {set_sql("o.doc_id")})) + len(list_intersect(words, {set_sql("o.body")}))) / len(words), 0) AS score FROM ask, base b LEFT JOIN other o ON o.doc_id = b.doc_id)
    SELECT doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, rank) AS INT) AS new_rank FROM scores"""
)
def counterfactual_rerank(spark, sf_dir):
    ask = rows(spark, "query_id int, query string", (0, "copper or linen of size Brand#11"))
    names = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.concat_ws(" ", F.min("p_name"), F.max("p_name")).alias("body"))
    ranked = rank.ranked_docs(parts_as_nodes(spark, sf_dir))
    found = rank.counterfactual_rerank(ask, ranked, names.withColumn("title", F.col("doc_id")))
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"), "new_rank")


@query(
    """WITH want AS (SELECT DISTINCT lang AS sample, source AS name FROM documents WHERE doc_id % 2 = 0), got AS (SELECT DISTINCT lang AS sample, source AS name FROM documents WHERE doc_id % 3 = 0),
    n AS (SELECT (SELECT count(*) FROM got g JOIN want w ON w.sample = g.sample AND w.name = g.name) AS r, (SELECT count(*) FROM want) AS w, (SELECT count(*) FROM got) AS g)
    SELECT round(r / g, 6) AS precision, round(r / w, 6) AS recall, round(2 * (r / g) * (r / w) / (r / g + r / w), 6) AS f1 FROM n"""
)
def extraction_f1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("sample"), F.col("source").alias("name"))
    pick = lambda n: docs.where(F.col("doc_id") % n == 0).select("sample", "name").distinct()
    return rank.extraction_metrics(pick(2), pick(3))


@query("SELECT conv_id, CASE WHEN count(*) = count(t) THEN CAST(sum(t) AS BIGINT) END AS total_tokens FROM (SELECT conv_id, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN NULL ELSE length(text) END AS t FROM conversations) GROUP BY conv_id")
def trace_totals(spark, sf_dir):
    calls = read(spark, sf_dir, "conversations").select("conv_id", F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), None).otherwise(F.length("text").cast("long")).alias("tokens"))
    return rank.trace_totals(calls)


# linking and merging

PART_GRAPH = "SELECT id, name, seq, doc_id, coalesce(doc_id, 'unknown') AS doc, lower(name) AS key FROM nodes"


@query(
    f"""{GRAPH_SQL}, r AS ({PART_GRAPH}) SELECT a.id AS source_id, b.id AS target_id, a.doc AS source_doc, b.doc AS target_doc, CAST(1.0 AS DOUBLE) AS confidence FROM r a JOIN r b ON a.key = b.key AND a.seq < b.seq AND a.doc <> b.doc
    WHERE a.key IN (SELECT key FROM r GROUP BY key HAVING count(DISTINCT doc_id) >= 2) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = a.id AND e.target_id = b.id)"""
)
def link_by_name(spark, sf_dir):
    return link.link_by_name(graph_of(spark, sf_dir))


@query(f"{GRAPH_SQL}, r AS ({PART_GRAPH}) SELECT key, count(*) AS nodes, count(DISTINCT doc_id) AS docs FROM r GROUP BY key HAVING count(DISTINCT doc_id) >= 2")
def link_groups(spark, sf_dir):
    return link.link_groups(graph_of(spark, sf_dir))


def supplier_aliases(g: Graph) -> DataFrame:
    """Suppliers get the name of the customer of their number as an alias."""
    return g.nodes.where("id like 's:%'").select("id", F.regexp_replace("name", "Supplier", "Customer").alias("alias"))


@query(
    f"""{GRAPH_SQL}, r AS ({PART_GRAPH}), x AS (SELECT id, replace(name, 'Supplier', 'Customer') AS alias FROM nodes WHERE id LIKE 's:%' UNION ALL SELECT id, upper(name) FROM nodes WHERE id LIKE 'p:%' AND seq % 7 = 0)
    SELECT a.id AS source_id, b.id AS target_id, a.doc AS source_doc, b.doc AS target_doc, CAST(0.8 AS DOUBLE) AS confidence FROM x JOIN r a ON a.id = x.id JOIN r b ON b.key = lower(x.alias) WHERE a.id <> b.id AND a.doc <> b.doc"""
)
def link_by_alias(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    upper = g.nodes.where("id like 'p:%' and seq % 7 = 0").select("id", F.upper("name").alias("alias"))
    return link.link_by_alias(g, supplier_aliases(g).unionByName(upper))


@query(
    f"""{GRAPH_SQL}, r AS ({PART_GRAPH}), c AS (SELECT a.id AS source_id, b.id AS target_id, CAST(CASE WHEN (a.seq + b.seq) % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM r a JOIN r b ON a.key = b.key AND a.id <> b.id AND a.doc <> b.doc
      WHERE a.id LIKE 'p:%' AND b.id LIKE 'p:%')
    SELECT source_id, target_id, confidence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY confidence DESC, source_id, target_id) AS INT) AS nth FROM c WHERE confidence >= 0.8) WHERE nth = 1"""
)
def link_apply(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    parts = g.nodes.where("id like 'p:%'").select("id", "seq", "doc_id", F.lower("name").alias("key"))
    sure = lambda a, b: F.when(a("doc_id") != b("doc_id"), F.when((a("seq") + b("seq")) % 2 == 0, 0.9).otherwise(0.5))
    return link.links_within(g, parts, sure)


CANON_SQL = f"""{GRAPH_SQL}, canon AS (SELECT id, first_value(id) OVER (PARTITION BY name ORDER BY seq) AS canonical FROM nodes WHERE node_class IN ('concept', 'fact') AND name <> '')"""


@query(f"{CANON_SQL} SELECT id, canonical FROM canon")
def dedup_canonical(spark, sf_dir):
    return link.canonical_ids(graph_of(spark, sf_dir).nodes)


@query(
    f"""{CANON_SQL}, moved AS (SELECT e.id, coalesce(a.canonical, e.source_id) AS source_id, coalesce(b.canonical, e.target_id) AS target_id, e.type FROM edges e LEFT JOIN canon a ON a.id = e.source_id LEFT JOIN canon b ON b.id = e.target_id)
    SELECT id, source_id, target_id, type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY id) AS INT) AS nth FROM moved WHERE source_id <> target_id) WHERE nth = 1"""
)
def synonym_migrate(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return link.redirect_edges(g.edges, link.canonical_ids(g.nodes)).select("id", "source_id", "target_id", "type")


@query(
    f"""{GRAPH_SQL}, own AS (SELECT me, child FROM drill WHERE me LIKE 'o:%'), sizes AS (SELECT me, count(*) AS members FROM own GROUP BY me HAVING count(*) >= 2)
    SELECT x.me AS node_id, h.me AS hub_id, CAST(s.members AS INT) AS members FROM sizes s JOIN own h ON h.me = s.me JOIN own x ON x.child = h.child AND x.me <> h.me GROUP BY x.me, h.me, s.members HAVING count(*) = s.members"""
)
def hub_absorb(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    orders = Graph(g.nodes, g.edges.where("source_id like 'o:%' and type = 'assoc'"))
    heads = orders.drill_down().groupBy("me").count().where("count >= 2").select(F.col("me").alias("id"))
    return link.absorbing_hubs(orders, heads).withColumn("members", F.col("members").cast("int"))


FOLD_SQL = f"""{GRAPH_SQL}, facts AS (SELECT 'o:' || o_orderkey AS id, 'c ' || o_custkey AS name, o_orderstatus || ' ' || o_orderpriority AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
against AS (SELECT me AS id, list(other) AS others FROM ends WHERE type = 'mutex' GROUP BY me),
merging(id, name, nth, first, text, apart, canonical) AS (SELECT f.id, f.name, f.nth, f.id, f.content, coalesce(a.others, []), f.id FROM facts f LEFT JOIN against a ON a.id = f.id WHERE f.nth = 1 UNION ALL
  SELECT id, name, nth, first, CASE WHEN fits THEN grown ELSE text END, CASE WHEN fits THEN list_concat(apart, others) ELSE apart END, CASE WHEN fits THEN first ELSE id END FROM (SELECT *,
    NOT list_contains(apart, id) AND {tokens_sql("'- ' || name || ' (id=' || first || ')' || chr(10) || '  ' || grown")} <= 40 AS fits FROM (
    SELECT f.id, f.name, f.nth, m.first, m.text, m.apart, coalesce(a.others, []) AS others, CASE WHEN contains(m.text, f.content) THEN m.text ELSE m.text || chr(10) || f.content END AS grown
    FROM merging m JOIN facts f ON f.name = m.name AND f.nth = m.nth + 1 LEFT JOIN against a ON a.id = f.id)))"""


@query(f"{FOLD_SQL} SELECT id, canonical FROM merging WHERE name IN (SELECT name FROM facts WHERE nth = 2)")
def dedup_nodes(spark, sf_dir):
    """Orders named by their customer: what each becomes, with mutex edges and a budget of 40 tokens in the way."""
    g = graph_of(spark, sf_dir)
    orders = read(spark, sf_dir, "orders")
    facts = orders.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c "), F.col("o_custkey").cast("string")).alias("name"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), F.lit("fact").alias("node_class"), F.col("o_orderkey").alias("seq"))
    return link.merge_plan(Graph(facts, g.edges), 40).select("id", "canonical")


# writing


@query(
    """SELECT doc_id, CASE WHEN flat = '' THEN 'ingest' WHEN length(flat) > 40 THEN substr(flat, 1, 40) || '…' ELSE flat END AS name
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)"""
)
def rule_ingest_events(spark, sf_dir):
    inputs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("ts"))
    return ingest.event_nodes(inputs).select(F.col("ingest_id").alias("doc_id"), "name")


@query(
    f"""{GRAPH_SQL} SELECT DISTINCT 'e:' || e.event_id AS source_id, n.id AS target_id FROM events e JOIN orders o ON o.o_custkey = e.user_id JOIN nodes n ON n.id = 'o:' || o.o_orderkey"""
)
def endorse_edges(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    endorsers = read(spark, sf_dir, "events").select(F.col("user_id").alias("ingest_id"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("id"))
    changed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ingest_id"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("target_id"))
    gone = changed.select("ingest_id", F.lit("x:1").alias("target_id")).unionByName(read(spark, sf_dir, "events").select(F.col("user_id").alias("ingest_id"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("target_id")))
    return ingest.endorsements(endorsers, changed.unionByName(gone), g.nodes)


@query(
    f"""{GRAPH_SQL}, known AS (SELECT lower(trim(name)) AS key, arg_min(id, seq) AS id FROM nodes WHERE node_class IN ('concept', 'fact') GROUP BY 1),
    d AS (SELECT doc_id AS pos, 'create' AS action, ' ' || upper(p_name) || ' ' AS name FROM documents JOIN part ON p_partkey = doc_id UNION ALL
      SELECT doc_id + 1000000, 'create', 'Topic ' || source FROM documents UNION ALL SELECT doc_id + 2000000, 'no_op', source FROM documents),
    k AS (SELECT d.*, lower(trim(d.name)) AS key, min(CASE WHEN action = 'create' THEN pos END) OVER (PARTITION BY lower(trim(d.name))) AS first FROM d)
    SELECT k.pos, CASE WHEN k.action = 'create' AND (known.id IS NOT NULL OR k.first < k.pos) THEN 'merge' ELSE k.action END AS action, k.name,
      CASE WHEN k.action = 'create' THEN coalesce(known.id, 'new::' || k.first) END AS target_id FROM k LEFT JOIN known ON known.key = k.key"""
)
def apply_create_merge(spark, sf_dir):
    docs, parts = read(spark, sf_dir, "documents"), read(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    row = lambda df, pos, action, name: df.select(pos.alias("pos"), F.lit(action).alias("action"), name.alias("name"), none.alias("target_id"), none.alias("node_class"))
    named = docs.join(parts, F.col("doc_id") == F.col("p_partkey"))
    d = row(named, F.col("doc_id"), "create", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")))
    d = d.unionAll(row(docs, F.col("doc_id") + 1_000_000, "create", F.concat(F.lit("Topic "), "source")))
    d = d.unionAll(row(docs, F.col("doc_id") + 2_000_000, "no_op", F.col("source")))
    return ingest.resolve_decisions(d, graph_of(spark, sf_dir).nodes)


@query(
    """WITH c AS (SELECT 'd' || doc_id % 10 AS doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, text AS content FROM documents)
    SELECT doc_id, chunk_id, sha256(content) AS content_hash FROM c WHERE chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0)"""
)
def idempotent_anti(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string")).alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    done = ingest.chunk_keys(chunks.where("cast(chunk_id as long) % 2 = 0")).drop("content")
    changed = ingest.chunk_keys(chunks.where("cast(chunk_id as long) % 2 = 1").withColumn("content", F.lit("older"))).drop("content")
    return ingest.new_chunks(chunks, done.unionByName(changed)).select("doc_id", "chunk_id", "content_hash")


@query(f"{GRAPH_SQL} SELECT id FROM nodes n WHERE node_class IN ('concept', 'fact') AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.me = n.id)")
def orphans(spark, sf_dir):
    return ingest.roots_to_hang(graph_of(spark, sf_dir))


@query(f"{GRAPH_SQL} SELECT id FROM nodes WHERE doc_id IS NULL")
def purge_orphans(spark, sf_dir):
    with_sources = graph_of(spark, sf_dir).nodes.withColumn("sources", F.when(F.col("doc_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("doc_id")))
    return ingest.orphans(with_sources).select("id")


@query(
    f"""{GRAPH_SQL}, d AS (SELECT c_custkey AS pos, c_nationkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(c_name) || ' ' ELSE 'Topic ' || c_mktsegment END AS name,
      CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' more' ELSE 'about ' || c_mktsegment || ' ' || c_nationkey || '.' END AS content FROM customer WHERE c_custkey % 3 < 2),
    known AS (SELECT name, content || chr(10) || content || ' more' AS content, 1 AS names FROM nodes JOIN customer ON id = 'c:' || c_custkey WHERE c_custkey % 3 = 0),
    parts AS (SELECT DISTINCT name, content, 'i' || k AS first FROM d WHERE name LIKE 'Topic %')
    SELECT name, content, CAST(names AS INT) AS names FROM known UNION ALL SELECT name, string_agg(content, chr(10) ORDER BY first), 0 FROM parts GROUP BY name"""
)
def ingest_apply(spark, sf_dir):
    """An input per nation, with decisions about its customers: merges into them, and topics of which all but the first are merged."""
    c = read(spark, sf_dir, "customer").withColumns({"kind": F.col("c_custkey") % 3, "ingest_id": F.concat(F.lit("i"), F.col("c_nationkey").cast("string"))})
    name = F.when(F.col("kind") == 0, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))).otherwise(F.concat(F.lit("Topic "), "c_mktsegment"))
    content = F.when(F.col("kind") == 0, F.concat("c_mktsegment", F.lit(" more"))).otherwise(F.concat(F.lit("about "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".")))
    none = F.lit(None).cast("string")
    decisions = c.select("ingest_id", F.col("c_custkey").alias("pos"), F.when(F.col("kind") < 2, "create").otherwise("no_op").alias("action"), name.alias("name"), content.alias("content"), none.alias("target_id"), none.alias("node_class"))
    inputs = read(spark, sf_dir, "nation").select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("ingest_id"), F.col("n_name").alias("content"), F.lit("2026").alias("ts"))
    done = ingest.apply(graph_of(spark, sf_dir), inputs, decisions)
    changed = done.graph.nodes.join(done.changed.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
    # what is merged into a customer's content is longer than it, so it gets a line of its own
    return changed.select("name", "content", F.size("aliases").alias("names"))


@query(
    """WITH d AS (SELECT 'i' || c_nationkey AS i, c_custkey AS pos, w || ' ' || c_mktsegment AS name, 'about ' || c_custkey || '.' AS content FROM customer, (VALUES ('First'), ('Second')) t(w))
    SELECT 'concept' AS node_class, name, string_agg(content, chr(10) ORDER BY i, pos) AS content, count(DISTINCT i) AS endorsed FROM d GROUP BY name
    UNION ALL SELECT 'event', n_name || ' ' || w, n_name || ' ' || w, 0 FROM nation, (VALUES ('First'), ('Second')) t(w)"""
)
def ingest_twice(spark, sf_dir):
    """Two ingests under the same names and places: what the first brought is there after the second, with its endorsements."""
    c, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    none = F.lit(None).cast("string")
    g = graph_of(spark, sf_dir)
    before = g.nodes.select("id")
    for word in ("First", "Second"):
        inputs = nation.select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("ingest_id"), F.concat("n_name", F.lit(f" {word}")).alias("content"), F.lit("2026").alias("ts"))
        decisions = c.select(
            F.concat(F.lit("i"), F.col("c_nationkey").cast("string")).alias("ingest_id"), F.col("c_custkey").alias("pos"), F.lit("create").alias("action"), F.concat(F.lit(f"{word} "), "c_mktsegment").alias("name"),
            F.concat(F.lit("about "), F.col("c_custkey").cast("string"), F.lit(".")).alias("content"), none.alias("target_id"), none.alias("node_class"),
        )
        g = ingest.apply(g, inputs, decisions).graph
    new = g.nodes.join(before, "id", "left_anti").select("id", "node_class", "name", "content")
    endorsed = g.edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("endorsed"))
    return new.join(endorsed, "id", "left").select("node_class", "name", "content", F.coalesce("endorsed", F.lit(0).cast("long")).alias("endorsed"))


@query(
    f"""{GRAPH_SQL}, s AS (SELECT doc_id, CAST(doc_id % 7 AS VARCHAR) AS chunk, CASE WHEN doc_id % 14 < 7 THEN 'new' ELSE 'old' END AS hash FROM documents)
    SELECT 'd:' || doc_id AS id, CAST(CASE WHEN (chunk IN ('0', '1') AND hash = 'new') OR doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS kept FROM s"""
)
def update_document(spark, sf_dir):
    """Sources of a document's chunks that are gone, or that have other content now, are forgotten; other documents' stay."""
    docs = read(spark, sf_dir, "documents")
    source = F.struct(F.when(F.col("doc_id") % 3 == 0, "other").otherwise("mine").alias("doc_id"), (F.col("doc_id") % 7).cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 14 < 7, "new").otherwise("old").alias("content_hash"))
    nodes = docs.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.array(source).alias("sources"))
    now = rows(spark, "chunk_id string, content_hash string", ("0", "new"), ("1", "new"))
    return ingest.pruned_sources(nodes, "mine", now).select("id", F.size("sources").alias("kept"))


@query(f"{GRAPH_SQL} SELECT e.id FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE (a.doc_id IS NOT NULL OR a.node_class <> 'concept') AND (b.doc_id IS NOT NULL OR b.node_class <> 'concept')")
def purge_apply(spark, sf_dir):
    """Concepts without a document go, with their edges; nodes of other classes never had sources."""
    g = graph_of(spark, sf_dir)
    sources = F.when(F.col("doc_id").isNotNull(), F.array("doc_id")).when(F.col("node_class") == "concept", F.array().cast("array<string>"))
    return g.without_nodes(ingest.orphans(g.nodes.withColumn("sources", sources)).select("id")).edges.select("id")


@query(f"{GRAPH_SQL} SELECT '__seed_root__>' || n.id || ':assoc' AS id FROM nodes n WHERE node_class IN ('concept', 'fact') AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.me = n.id)")
def root_hang(spark, sf_dir):
    return maintain.rooted(graph_of(spark, sf_dir)).edges.where(F.col("source_id") == ROOT).select("id")


@query(
    f"""{GRAPH_SQL}, s AS (SELECT id, content, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 'short' ELSE 'was long' END AS text, CASE WHEN seq % 3 = 2 THEN length(content) + 1 ELSE length(content) END AS len FROM nodes WHERE node_class = 'concept')
    SELECT id FROM s WHERE text IS NULL OR len <> length(content)"""
)
def summary_stale(spark, sf_dir):
    nth = F.col("seq") % 3
    summary = F.struct(F.when(nth == 0, F.lit(None)).when(nth == 1, "short").otherwise("was long").alias("text"), (F.length("content") + (nth == 2).cast("int")).alias("length"))
    return maintain.stale_summaries(graph_of(spark, sf_dir).of_class("concept").withColumn("summary", summary)).select("id")


# bounding


@query(
    """WITH m AS (SELECT n_nationkey AS center, 'c:' || c_custkey AS id, c_mktsegment AS theme FROM nation JOIN customer ON c_nationkey = n_nationkey),
    g AS (SELECT center, theme, list_sort(list(id)) AS member_ids FROM m GROUP BY center, theme)
    SELECT center, theme, len(member_ids) AS members, CASE WHEN len(member_ids) > 1 THEN 'key_concept' ELSE 'summarize' END AS strategy FROM g"""
)
def community_validate(spark, sf_dir):
    m = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("center"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("theme"))
    groups = m.groupBy("center", "theme").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    key = F.when(F.size("ids") > 1, F.element_at("ids", 2)).otherwise("x:1")
    proposed = groups.select("center", "theme", F.lit("key_concept").alias("strategy"), key.alias("key_id"), F.concat("ids", F.array(F.lit("x:9"))).alias("member_ids"))
    empty = groups.select("center", F.lit("none").alias("theme"), F.lit("merge").alias("strategy"), F.lit("x:1").alias("key_id"), F.array(F.lit("x:8")).alias("member_ids"))
    return compact.valid_communities(proposed.unionByName(empty), m).select("center", "theme", F.size("member_ids").cast("long").alias("members"), "strategy")


@query(
    f"""{GRAPH_SQL}, plan AS (SELECT 'n:' || c_nationkey AS center, 'h:' || c_nationkey || c_mktsegment AS hub, 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT source_id, target_id, type FROM edges e WHERE NOT (type = 'assoc' AND EXISTS (SELECT 1 FROM plan p WHERE p.center = e.source_id AND p.id = e.target_id))
    UNION ALL SELECT DISTINCT hub, id, 'assoc' FROM plan UNION ALL SELECT DISTINCT center, hub, 'assoc' FROM plan"""
)
def reorganise(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    plan = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(key("n:", "c_nationkey").alias("center"), F.concat(key("h:", "c_nationkey"), "c_mktsegment").alias("hub"), key("c:", "c_custkey").alias("id"))
    return compact.reorganised_edges(g.edges, plan).select("source_id", "target_id", "type")


@query(
    """WITH h AS (SELECT 'n:' || n_nationkey AS id, n_nationkey AS seq, list_distinct(string_split(lower('nation of region ' || n_regionkey), ' ')) AS w FROM nation),
    s AS (SELECT n_nationkey AS key, list_distinct(string_split(lower('Nation of region ' || (n_nationkey % 7)), ' ')) AS w FROM nation)
    SELECT s.key, arg_min(h.id, h.seq) AS hub_id FROM s, h WHERE len(list_intersect(s.w, h.w)) / len(list_distinct(list_concat(s.w, h.w))) >= 0.7 GROUP BY s.key"""
)
def hub_similar(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    hubs = nation.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("content"))
    return compact.similar_hubs(nation.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("Nation of region "), (F.col("n_nationkey") % 7).cast("string")).alias("summary")), hubs)


@query()
def compact_graph(spark, sf_dir):
    return budget.neighbourhood_costs(compact.compact(graph_of(spark, sf_dir), 300)).select("id", "members", "tokens")


# scalar functions


@query(
    """SELECT doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS norm, sha256(text) AS hash, substr(md5(text), 1, 12) AS query_id, coalesce(nullif(substr(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], 1, 40), ''), 'hub') AS short
    FROM documents"""
)
def scalar_names(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.norm_name(text).alias("norm"), tx.content_hash(text).alias("hash"), tx.query_id(text).alias("query_id"), tx.short_name(text).alias("short"))


@query()
def chunk_body(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunk_body(F.col("source"), F.col("text"))).alias("pos", "chunk"))
    return docs


@query(
    """SELECT n AS id, list_distinct(list_transform(list_filter(list_transform(list_filter(string_split_regex(trim(raw), '[,\\s]+'), lambda p: regexp_full_match(p, '[0-9]{1,9}')), lambda p: CAST(p AS INT)), lambda i: i BETWEEN 1 AND 10), lambda i: i - 1))::VARCHAR AS picked
    FROM (SELECT n_nationkey AS n, n_nationkey || ', 3,1 none 12 ' || (n_nationkey % 4) AS raw FROM nation)""".replace("list_distinct(", "list_sort(list_distinct(").replace("))::VARCHAR", ")))::VARCHAR")
)
def parse_indices(spark, sf_dir):
    raw = F.concat(F.col("n_nationkey").cast("string"), F.lit(", 3,1 none 12 "), (F.col("n_nationkey") % 4).cast("string"))
    picked = F.array_sort(tx.ranked_indices(raw, F.lit(10)))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), picked.cast("string").alias("picked"))


@query("SELECT source, CAST(sum(1 + length(text) // 1200) AS BIGINT) AS calls FROM documents GROUP BY source")
def cost_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(1 + F.floor(F.length("text") / 1200)).alias("calls"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


@query(
    """SELECT e.vec_id, round(list_dot_product(e.embedding, q.embedding) / sqrt(list_dot_product(e.embedding, e.embedding) * list_dot_product(q.embedding, q.embedding)), 3) AS cosine
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""
)
def embedding_cosine(spark, sf_dir):
    """The seam for a scorer of embeddings; the specification leaves it open."""
    vectors = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    first = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q"), F.lit(0).alias("k")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = vectors.withColumn("k", F.lit(0)).join(first, "k")
    return both.select("vec_id", F.round(dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")), 3).alias("cosine"))
