"""A property graph derived from the star-schema tables by plain projections.

The statements are portable: ``{table}`` stands for a table, ``{collapsed}`` for the dialect's way
to collapse white space in ``text``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from loamgraph.operators.graph import Graph

NODES = """
SELECT 'r:' || r_regionkey AS id, r_name AS name, r_name AS content, 'concept' AS node_class, true AS hub,
       CAST(NULL AS STRING) AS doc_id, CAST(NULL AS STRING) AS event_ts, CAST(r_regionkey AS BIGINT) AS seq FROM {region}
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation of region ' || n_regionkey, 'concept', true, NULL, NULL,
       1000000000000 + n_nationkey FROM {nation}
UNION ALL SELECT 'c:' || c_custkey, c_name, c_mktsegment, 'concept', false, NULL, NULL, 2000000000000 + c_custkey FROM {customer}
UNION ALL SELECT 's:' || s_suppkey, s_name, 'nation ' || s_nationkey, 'concept', false, NULL, NULL,
       3000000000000 + s_suppkey FROM {supplier}
UNION ALL SELECT 'p:' || p_partkey, p_name, p_brand || ' ' || p_type, 'concept', false, p_brand, NULL,
       4000000000000 + p_partkey FROM {part}
UNION ALL SELECT 'o:' || o_orderkey, 'order ' || o_orderkey, o_orderstatus || ' ' || o_orderpriority, 'fact', false, NULL, NULL,
       5000000000000 + o_orderkey FROM {orders}
UNION ALL SELECT 'e:' || event_id, event_type, props, 'event', false, NULL, replace(CAST(ts AS STRING), ' ', 'T'),
       6000000000000 + event_id FROM {events}
UNION ALL SELECT 'd:' || doc_id,
       CASE WHEN length({collapsed}) > 40 THEN substr({collapsed}, 1, 40) || '…' ELSE {collapsed} END,
       text, 'source', false, source, NULL, 7000000000000 + doc_id FROM {documents}
"""

EDGES = """
SELECT source_id || '>' || target_id || ':' || type AS id, source_id, target_id, type, 0.0 AS priority FROM (
SELECT 'r:' || n_regionkey AS source_id, 'n:' || n_nationkey AS target_id, 'assoc' AS type FROM {nation}
UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'assoc' FROM {customer}
UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'assoc' FROM {orders}
UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'assoc' FROM {lineitem}
UNION ALL SELECT 'e:' || event_id, 'c:' || user_id, 'assoc' FROM {events}
UNION ALL SELECT 'd:' || d.doc_id, 'p:' || p.p_partkey, 'assoc' FROM {documents} d JOIN {part} p ON d.doc_id = p.p_partkey
UNION ALL SELECT 'o:' || a.o_orderkey, 'o:' || b.o_orderkey, 'mutex' FROM {orders} a JOIN {orders} b
    ON a.o_custkey = b.o_custkey AND date_trunc('month', a.o_orderdate) = date_trunc('month', b.o_orderdate)
    AND a.o_orderstatus <> b.o_orderstatus AND a.o_orderkey < b.o_orderkey) edge_rows
"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
COLLAPSED = {
    "spark": r"trim(regexp_replace(text, '[ \\n\\t\\r]+', ' '))",
    "duckdb": "trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'))",
}


def statements(dialect: str, names: dict[str, str]) -> tuple[str, str]:
    """The statements for nodes and edges, for tables under ``names``."""
    return tuple(s.format(**names, collapsed=COLLAPSED[dialect]) for s in (NODES, EDGES))


def derive_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables in ``sf_dir``; scans and projections only, but for two joins."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    nodes, edges = (spark.sql(s) for s in statements("spark", names))
    return Graph(nodes, edges)
