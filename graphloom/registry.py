"""Where queries are registered, and the SQL of the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The views of sources.tables in SQL.
NODE = """node AS (SELECT 'r' || r_regionkey AS id, 'indexable' AS kind, lower(r_name) AS name, 'place' AS type FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'indexable', lower(n_name), 'place' FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'indexable', lower(s_name), 'organization' FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'indexable', lower(c_name), 'person' FROM customer
 UNION ALL SELECT 'p' || p_partkey, 'indexable', lower(p_name), 'thing' FROM part
 UNION ALL SELECT 'o' || o_orderkey, 'note', NULL, NULL FROM orders)"""
REL = """rel AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'located_in' AS rel_type, 9.0::DOUBLE AS confidence, 1::BIGINT AS mention_count FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 9.0::DOUBLE, 1 FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', 9.0::DOUBLE, 1 FROM customer
 UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'supplies', 1 + ((l_suppkey + l_partkey) % 10) * 0.9::DOUBLE, count(*) FROM lineitem GROUP BY l_suppkey, l_partkey
 UNION ALL SELECT 'c' || o_custkey, 's' || l_suppkey, 'buys_from', 1 + ((o_custkey + l_suppkey) % 10) * 0.9::DOUBLE, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey)"""
REF = """ref AS (SELECT DISTINCT 'o' || l_orderkey AS note_id, 'p' || l_partkey AS node_id FROM lineitem
 UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""
MEMBER = """member AS (SELECT 'p' || p_partkey AS node_id, 'community_l2_' || p_brand AS community_id, 2 AS level FROM part
 UNION ALL SELECT 'p' || p_partkey, 'community_l1_' || p_type, 1 FROM part
 UNION ALL SELECT 'p' || p_partkey, 'community_l0_' || (p_size // 10), 0 FROM part)"""
ASSERTED = """asserted AS (SELECT event_id, ts, 'u' || user_id AS src, 'k' || (json_extract_string(props, '$.k')::BIGINT % 10) AS dst,
 CASE event_type WHEN 'signup' THEN 'knows' WHEN 'view' THEN 'learning' WHEN 'click' THEN 'works_with' WHEN 'purchase' THEN 'friends_with' WHEN 'error' THEN 'hates' END AS rel_type,
 greatest(1.0::DOUBLE, least(10.0::DOUBLE, value / 10)) AS confidence FROM events)"""
NOTE = """note AS (SELECT d.doc_id AS id, array_to_string(string_split(text, ' ')[1:3], ' ') AS title, text AS content, coalesce(quality = 1, false) AS processed, coalesce(toxic = 1, false) AS failed, lang AS kb_id FROM documents d LEFT JOIN labels y USING (doc_id))"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
