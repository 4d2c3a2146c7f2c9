"""Queries over linear sequences, structure names and ambiguous structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import notation as ops
from sugarmill.operators import structures
from sugarmill.plans import base
from sugarmill.plans.base import NODES, query
from sugarmill.plans.trees import PRE
from sugarmill.sources import derived, facts

CODES = "codes(class_id, code, crank) AS (VALUES " + ", ".join(f"({k}, '{s[6]}', {s[7]})" for k, s in enumerate(facts.SYMBOL_KEYS)) + ")"
#: Labels and sibling order; then texts from the deepest level up.
LIN = f"""{NODES}, {CODES}, {PRE}, lab AS (SELECT n.glycan_id, n.node, n.parent, len(p.path) - 1 AS depth, c.code || n.anomer || CASE WHEN n.parent IS NULL THEN '' ELSE n.parent_pos::VARCHAR END AS label, c.code, n.anomer, n.parent_pos, c.crank * 10 - n.parent_pos AS rank FROM nodes n JOIN codes c USING (class_id) JOIN pre p USING (glycan_id, node)),
sib AS (SELECT *, row_number() OVER (PARTITION BY glycan_id, parent ORDER BY rank, node) AS rn, count(*) OVER (PARTITION BY glycan_id, parent) AS cnt FROM lab),
l8 AS (SELECT NULL::BIGINT AS glycan_id, NULL::BIGINT AS parent, NULL::BIGINT AS rn, NULL::BIGINT AS cnt, NULL::BIGINT AS node, NULL::VARCHAR AS text WHERE FALSE)""" + "".join(
    f", l{k} AS (SELECT s.glycan_id, s.parent, s.rn, s.cnt, s.node, coalesce((SELECT string_agg(CASE WHEN c.rn > 1 THEN '(' || c.text || ')' ELSE c.text END, '' ORDER BY c.rn) FROM l{k + 1} c WHERE c.glycan_id = s.glycan_id AND c.parent = s.node), '') || s.label AS text FROM sib s WHERE s.depth = {k})" for k in range(7, -1, -1)
)


def labelled(spark, d):
    n = derived.nodes(spark, d)
    codes = facts.small(spark, [(k, s[6], s[7]) for k, s in enumerate(facts.SYMBOL_KEYS)], "class_id int, code string, crank int")
    label = F.expr("concat(code, anomer, case when parent is null then '' else cast(parent_pos as string) end)")
    return n.join(codes, "class_id").join(structures.preorder(n), ["glycan_id", "node"]).select("glycan_id", "node", "parent", "depth", label.alias("label"), (F.col("crank") * 10 - F.col("parent_pos")).alias("rank"))


def sequences(spark, d):
    return ops.linear(labelled(spark, d))


@query("linear_text", f"WITH RECURSIVE {LIN} SELECT glycan_id, text FROM l0")
def linear_text(spark, d):
    return sequences(spark, d)


@query("linear_residues", f"""WITH RECURSIVE {LIN}, ord AS (SELECT glycan_id, node, []::BIGINT[] AS path FROM sib WHERE parent IS NULL UNION ALL SELECT s.glycan_id, s.node, list_append(o.path, -s.rn) FROM ord o JOIN sib s ON s.glycan_id = o.glycan_id AND s.parent = o.node),
num AS (SELECT glycan_id, node, (row_number() OVER (PARTITION BY glycan_id ORDER BY path) - 1)::INT AS place FROM ord)
SELECT s.glycan_id, a.place, b.place AS parent, s.code, s.anomer, CASE WHEN s.parent IS NOT NULL THEN s.parent_pos::VARCHAR END AS pos FROM sib s JOIN num a ON a.glycan_id = s.glycan_id AND a.node = s.node LEFT JOIN num b ON b.glycan_id = s.glycan_id AND b.node = s.parent""")
def linear_residues(spark, d):
    return ops.linear_residues(sequences(spark, d), "glycan_id", "text")


BROKEN = "CASE glycan_id % 17 WHEN 1 THEN text || '*' WHEN 2 THEN 'XXa3' || text WHEN 3 THEN '(' || text ELSE text END"


@query("linear_rejects", f"WITH RECURSIVE {LIN} SELECT glycan_id, CASE glycan_id % 17 WHEN 1 THEN 'bad format' WHEN 2 THEN 'unknown symbol' ELSE 'unbalanced' END AS reason FROM l0 WHERE glycan_id % 17 IN (1, 2, 3)")
def linear_rejects(spark, d):
    rows = sequences(spark, d).withColumn("text", F.expr(BROKEN))
    return ops.linear_rejects(rows, "glycan_id", "text", [s[6] for s in facts.SYMBOL_KEYS])


NAMES = "names AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS f, 1 + c_custkey % 5 AS a, c_custkey % 7 = 0 AS b, c_custkey % 4 AS g, c_custkey % 11 % 4 AS s FROM customer), whole AS (SELECT *, CASE WHEN a > 4 THEN 'bad name' WHEN g > a THEN 'more galactoses than antennae' WHEN s > g THEN 'more sialic acids than galactoses' END AS reason FROM names)"


def oxford(spark, d):
    c = derived.table(spark, d, "customer").selectExpr("c_custkey as k", "concat(if(c_custkey % 3 = 0, 'F', ''), 'A', 1 + c_custkey % 5, if(c_custkey % 7 = 0, 'B', ''), 'G', c_custkey % 4, 'S', c_custkey % 11 % 4) as name")
    return ops.named(c, "k", "name")


@query("oxford_rejects", f"WITH {NAMES} SELECT k, reason FROM whole WHERE reason IS NOT NULL")
def oxford_rejects(spark, d):
    return oxford(spark, d).filter("reason is not null").select("k", "reason")


@query("oxford_expand", f"""WITH {NAMES}, good AS (SELECT * FROM whole WHERE reason IS NULL), ant(n, man, pos) AS (VALUES (1, 3, 2), (2, 4, 2), (3, 3, 4), (4, 4, 6)), core(residue, symbol, parent, pos) AS (VALUES (0, 'GlcNAc', NULL, NULL), (1, 'GlcNAc', 0, 4), (2, 'Man', 1, 4), (3, 'Man', 2, 3), (4, 'Man', 2, 6))
SELECT k, core.* FROM good, core UNION ALL SELECT k, 5, 'Fuc', 0, 6 FROM good WHERE f UNION ALL SELECT k, 6, 'GlcNAc', 2, 4 FROM good WHERE b UNION ALL SELECT k, n * 10, 'GlcNAc', man, pos FROM good, ant WHERE n <= a
UNION ALL SELECT k, n * 10 + 1, 'Gal', n * 10, 4 FROM good, ant WHERE n <= g UNION ALL SELECT k, n * 10 + 2, 'NeuAc', n * 10 + 1, 6 FROM good, ant WHERE n <= s""")
def oxford_expand(spark, d):
    antennae = facts.small(spark, ops.ANTENNAE, "antenna int, mannose int, position int")
    return ops.expanded(oxford(spark, d), antennae, "k")


FLOAT = f"{NODES}, floating AS (SELECT * FROM nodes WHERE parent IS NOT NULL AND (glycan_id * 3 + node) % 5 = 0), options AS (SELECT f.glycan_id, f.node, f.class_id, c.node AS candidate FROM floating f JOIN nodes c ON c.glycan_id = f.glycan_id AND c.node < f.node AND (c.class_id + f.class_id) % 2 = 0)"


def floating(spark, d):
    n = derived.nodes(spark, d)
    f = n.filter("parent is not null and (glycan_id * 3 + node) % 5 = 0").select("glycan_id", "node", "class_id")
    c = n.select("glycan_id", F.col("node").alias("candidate"), F.col("class_id").alias("cc"))
    return f.join(c, "glycan_id").filter("candidate < node and (cc + class_id) % 2 = 0").select("glycan_id", "node", "class_id", "candidate")


@query("instantiation_count", f"WITH {FLOAT} SELECT glycan_id, product(k)::BIGINT AS n FROM (SELECT glycan_id, node, count(*) AS k FROM options GROUP BY ALL) GROUP BY 1")
def instantiation_count(spark, d):
    return ops.instantiation_counts(floating(spark, d))


@query("instantiations", f"WITH RECURSIVE {FLOAT}, o AS (SELECT *, dense_rank() OVER (PARTITION BY glycan_id ORDER BY node) AS k FROM options), walk AS (SELECT glycan_id, 1::BIGINT AS k, candidate::VARCHAR AS choice FROM o WHERE k = 1 UNION ALL SELECT w.glycan_id, o.k, w.choice || ',' || o.candidate FROM walk w JOIN o ON o.glycan_id = w.glycan_id AND o.k = w.k + 1) SELECT w.glycan_id, w.choice FROM walk w JOIN (SELECT glycan_id, max(k) AS k FROM o GROUP BY 1) m USING (glycan_id, k)")
def instantiations(spark, d):
    rows = ops.instantiations(floating(spark, d))
    return rows.select("glycan_id", F.array_join(F.transform("choice", lambda c: c.cast("string")), ",").alias("choice"))


@query("undetermined_classes", f"WITH {FLOAT}, k AS (SELECT glycan_id, node, class_id, string_agg(candidate::VARCHAR, ',' ORDER BY candidate) AS parents FROM options GROUP BY ALL) SELECT glycan_id, class_id, parents, min(node) AS first_node, count(*) AS n FROM k GROUP BY ALL")
def undetermined_classes(spark, d):
    k = floating(spark, d).groupBy("glycan_id", "node", "class_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("candidate")), lambda c: c.cast("string")), ",").alias("parents"))
    return k.groupBy("glycan_id", "class_id", "parents").agg(F.min("node").alias("first_node"), F.count("*").alias("n"))


LOOSE = f"""{base.NODES}, leafs AS (SELECT n.*, NOT EXISTS (FROM nodes c WHERE c.glycan_id = n.glycan_id AND c.parent = n.node) AND n.glycan_id % 3 < 2 AND n.node % 2 = 1 AS flip FROM nodes n WHERE n.parent IS NOT NULL),
links AS (SELECT glycan_id, CASE WHEN flip THEN node ELSE parent END AS parent, CASE WHEN flip THEN parent ELSE node END AS child, CASE WHEN flip AND glycan_id % 3 = 0 THEN NULL ELSE parent_pos END AS parent_pos, CASE WHEN flip AND glycan_id % 3 = 0 THEN NULL ELSE 1 END AS child_pos FROM leafs)"""


@base.query("wurcs_link_repair", f"""WITH {LOOSE},
heads AS (SELECT glycan_id, node, (SELECT count(*) FROM links l WHERE l.glycan_id = n.glycan_id AND (l.parent = n.node OR l.child = n.node)) = 1 AND EXISTS (FROM links l WHERE l.glycan_id = n.glycan_id AND l.parent = n.node AND l.parent_pos IS NULL AND l.child_pos IS NULL) AS turn
  FROM nodes n WHERE NOT EXISTS (FROM links l WHERE l.glycan_id = n.glycan_id AND l.child = n.node)),
good AS (SELECT glycan_id FROM heads h GROUP BY 1 HAVING count(*) > 1 AND count(*) < (SELECT count(*) FROM nodes n WHERE n.glycan_id = h.glycan_id) AND count(*) FILTER (turn) = count(*) - 1),
r AS (SELECT l.*, EXISTS (FROM heads h JOIN good USING (glycan_id) WHERE h.turn AND h.glycan_id = l.glycan_id AND h.node = l.parent) AS reversed FROM links l)
SELECT glycan_id, CASE WHEN reversed THEN child ELSE parent END AS parent, CASE WHEN reversed THEN parent ELSE child END AS child, (CASE WHEN reversed THEN child_pos ELSE parent_pos END)::INT AS parent_pos, (CASE WHEN reversed THEN parent_pos ELSE child_pos END)::INT AS child_pos, reversed FROM r""")
def wurcs_link_repair(spark, d):
    n = derived.nodes(spark, d)
    parents = n.filter("parent is not null").select("glycan_id", F.col("parent").alias("node"), F.lit(True).alias("has_child")).distinct()
    links = n.filter("parent is not null").join(parents, ["glycan_id", "node"], "left").withColumn("flip", F.expr("has_child is null and glycan_id % 3 < 2 and node % 2 = 1"))
    unknown = "if(flip and glycan_id % 3 = 0, null, {})"
    links = links.selectExpr("glycan_id", "if(flip, node, parent) as parent", "if(flip, parent, node) as child", unknown.format("parent_pos") + " as parent_pos", unknown.format("1") + " as child_pos")
    return ops.links_repaired(n.select("glycan_id", "node"), links)
