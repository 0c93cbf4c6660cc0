"""Common table expressions of the queries' SQL, written from the same declared rules."""

from lucerna.plans.policy import RULES


def quoted(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def condition(rule: dict) -> str:
    if "all" in rule:
        return "(" + " AND ".join(map(condition, rule["all"])) + ")" if rule["all"] else "TRUE"
    if "any" in rule:
        return "(" + " OR ".join(map(condition, rule["any"])) + ")" if rule["any"] else "FALSE"
    if "operation" in rule:
        return f"list_contains(operations, {quoted(rule['operation'])})"
    parts = []
    for k, v in rule["cell"].items():
        parts.append(f"{k} IN ({', '.join(map(quoted, v if isinstance(v, list) else [v]))})")
    return "(" + " AND ".join(parts) + ")"


ITEMS = """items AS (SELECT *, 'CELL_' || upper(substr(sha256(kind || '|' || size || '|' || brand), 1, 16)) AS cell_id,
  CASE WHEN kind = 'PROMO' THEN 'novel_feature_holdout' WHEN (CAST(substr(size, 2) AS INT) + CAST(substr(brand, 2) AS INT)) % 3 = 0 THEN 'compositional_holdout' ELSE 'development' END AS canonical_split
  FROM (SELECT p_partkey AS item_id, p_type AS kind, 'S' || CAST((p_size - 1) // 10 AS INT) AS size, 'B' || (CAST(substr(p_brand, 7) AS INT) % 3) AS brand, string_split(p_name, ' ') AS operations, p_retailprice AS price FROM part))"""
LABELS = "labels_ AS (" + " UNION ALL ".join(f"SELECT item_id, '{r['kc_id']}' AS kc FROM items WHERE {condition(r['rule'])}" for r in RULES) + ")"
CELLS = "cells AS (SELECT cell_id, kind, size, brand, canonical_split, count(*) AS n_items FROM items GROUP BY ALL)"
EVENTS = "ev AS (SELECT event_id, user_id AS learner, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, CASE WHEN value >= 35 THEN 1 ELSE 0 END AS correct FROM events)"
BIG = """big AS (SELECT o_custkey AS learner, l_partkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
