"""The registry behind ``sugarmill.plans``, and the DuckDB spelling of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TRUTH = """truth_base AS (SELECT *, (image_id * 3 + s2) % 8 AS class_id FROM (
  SELECT o_orderkey AS k, o_orderkey // 8 AS image_id,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 8 > 0 THEN o_orderkey % 8 - 1 ELSE o_orderkey % 8 END AS s2,
    40 + (o_orderkey * 7) % 30 AS w, 40 + (o_orderkey * 13) % 30 AS h FROM orders)),
truth AS (SELECT k AS box_id, image_id, CAST(class_id AS INT) AS class_id,
  CAST(20 + (s2 % 4) * 150 + (k * 17) % 16 AS INT) AS x, CAST(20 + (s2 // 4) * 180 + (k * 23) % 16 AS INT) AS y,
  CAST(w AS INT) AS w, CAST(h AS INT) AS h, 640 AS imwidth, 400 AS imheight FROM truth_base)"""

DET = (
    TRUTH
    + """,
det AS (
SELECT box_id AS det_id, image_id, CAST(CASE WHEN box_id % 13 = 0 THEN (class_id + 1) % 8 ELSE class_id END AS INT) AS class_id,
  CAST(x + (box_id * 31) % 11 - 5 AS INT) AS x, CAST(y + (box_id * 37) % 11 - 5 AS INT) AS y,
  CAST(w + (box_id * 41) % 9 - 4 AS INT) AS w, CAST(h + (box_id * 43) % 9 - 4 AS INT) AS h,
  ((box_id * 7919) % 9901)::DOUBLE / 10000 AS conf FROM truth WHERE box_id % 11 <> 0
UNION ALL
SELECT 1000000 + box_id, image_id, class_id, CAST(x + (box_id * 53) % 21 - 10 AS INT), CAST(y + (box_id * 59) % 21 - 10 AS INT), w, h,
  ((box_id * 104729) % 9901)::DOUBLE / 10000 FROM truth WHERE box_id % 3 = 0
UNION ALL
SELECT 2000000 + event_id, event_id // 8, CAST(event_id % 8 AS INT), CAST((event_id * 29) % 560 AS INT), CAST((event_id * 31) % 330 AS INT),
  CAST(40 + event_id % 30 AS INT), CAST(40 + (event_id * 3) % 30 AS INT), ((event_id * 6101) % 9901)::DOUBLE / 10000 FROM events WHERE event_id % 20 = 0)"""
)

NODES = """nodes AS (SELECT o_orderkey // 8 AS glycan_id, o_orderkey % 8 AS node,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % (o_orderkey % 8) END AS parent,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_custkey % 8 END AS INT) AS class_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS anomer,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS INT) AS parent_pos FROM orders)"""

SYMBOL = """dim_symbol(class_id, symbol) AS (VALUES (0, 'GlcNAc'), (1, 'NeuAc'), (2, 'Fuc'), (3, 'Man'), (4, 'GalNAc'), (5, 'Gal'), (6, 'Glc'), (7, 'NeuGc'))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the DuckDB statement with the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
