"""Queries that compare glycans whose residues may have several possible parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import dags as ops
from sugarmill.plans.base import NODES, query
from sugarmill.sources import derived

#: Trees with a second possible parent for some residues; few labels, so that glycans repeat.
EDGES = f"""{NODES}, lab AS (SELECT glycan_id AS g, node, CASE WHEN class_id IN (1, 7) THEN 'S' ELSE 'H' END AS label FROM nodes),
edges AS (SELECT glycan_id AS g, parent, node AS child, 'o' AS label FROM nodes WHERE parent IS NOT NULL UNION SELECT glycan_id, (parent + 1) % node, node, 'u' FROM nodes WHERE parent IS NOT NULL AND node > 1 AND (glycan_id + node) % 6 = 0)"""
ROUND = "c{1} AS MATERIALIZED (SELECT c.g, c.node, md5(c.col || '<' || coalesce(u.t, '') || '>' || coalesce(d.t, '')) AS col FROM c{0} c LEFT JOIN (SELECT e.g, e.child AS node, string_agg(e.label || '=' || p.col, ',' ORDER BY e.label || '=' || p.col) AS t FROM edges e JOIN c{0} p ON p.g = e.g AND p.node = e.parent GROUP BY ALL) u ON u.g = c.g AND u.node = c.node LEFT JOIN (SELECT e.g, e.parent AS node, string_agg(e.label || '=' || p.col, ',' ORDER BY e.label || '=' || p.col) AS t FROM edges e JOIN c{0} p ON p.g = e.g AND p.node = e.child GROUP BY ALL) d ON d.g = c.g AND d.node = c.node)"
REFINED = f"WITH {EDGES}, c0 AS MATERIALIZED (SELECT g, node, md5(label) AS col FROM lab), " + ", ".join(ROUND.format(k, k + 1) for k in range(8))
SAME = """SELECT n.g AS glycan_id, min(n.g) OVER (PARTITION BY n.t, e.t) AS class_id, n.n::INT AS n_nodes, n.k::INT AS n_colours, n.n = n.k OR (e.n = n.n - 1 AND e.kids = n.n - 1) AS decided
FROM (SELECT g, count(*) AS n, count(DISTINCT col) AS k, string_agg(col, ',' ORDER BY col) AS t FROM c8 GROUP BY 1) n
LEFT JOIN (SELECT e.g, count(*) AS n, count(DISTINCT e.child) AS kids, string_agg(p.col || e.label || c.col, ',' ORDER BY p.col || e.label || c.col) AS t FROM edges e JOIN c8 p ON p.g = e.g AND p.node = e.parent JOIN c8 c ON c.g = e.g AND c.node = e.child GROUP BY 1) e ON e.g = n.g"""


def given(spark, d):
    nodes = derived.nodes(spark, d)
    first = nodes.filter("parent is not null").select("glycan_id", "parent", F.col("node").alias("child"), F.lit("o").alias("label"))
    second = nodes.filter("parent is not null and node > 1 and (glycan_id + node) % 6 = 0").select("glycan_id", F.expr("(parent + 1) % node").alias("parent"), F.col("node").alias("child"), F.lit("u").alias("label"))
    return nodes.select("glycan_id", "node", F.when(F.col("class_id").isin(1, 7), "S").otherwise("H").alias("label")), first.unionByName(second)


@query("dag_equal_candidates", f"{REFINED} {SAME}")
def dag_equal_candidates(spark, d):
    return ops.equal_candidates(*given(spark, d), single_out=False)


@query("dag_equal")
def dag_equal(spark, d):
    """As ``dag_equal_candidates``, with glycans that refinement leaves open refined again; compared with all matchings in the tests."""
    return ops.equal_candidates(*given(spark, d))
