"""Queries that compare residues on all fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import residues as ops
from sugarmill.plans.base import NODES, query
from sugarmill.sources import derived

#: Residues of all orders with unknown fields here and there.
PARTS = """o_orderkey AS residue, CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS anomer, CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NON' ELSE 'HEX' END AS superclass,
  CASE WHEN o_custkey % 11 < 3 THEN NULL ELSE 1 END AS ring_start, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 4 ELSE 5 END AS ring_end"""
SQL = f"""res AS (SELECT {PARTS}, CASE WHEN o_custkey % 7 = 1 THEN ['gro', CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 'gal' END] ELSE [CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'glc' ELSE 'man' END] END AS stems,
  CASE WHEN o_custkey % 7 = 1 THEN ['d', NULL] WHEN o_custkey % 3 = 0 THEN [NULL] ELSE ['d'] END AS configs, CASE o_custkey % 4 WHEN 0 THEN ['6:d'] WHEN 1 THEN ['?:d'] ELSE [] END AS mods,
  CASE o_orderkey % 5 WHEN 0 THEN ['2/lost/nAcetyl'] WHEN 1 THEN ['2/lost/nAcetyl', '6/kept/sulfate'] WHEN 2 THEN ['6/kept/sulfate', '2/lost/nAcetyl'] WHEN 3 THEN ['3/lost/nAcetyl'] ELSE [] END AS substituents FROM orders)"""
SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("anomer", "superclass", "ring_start", "ring_end", "stems", "configs", "mods"))
FORMS = f"{SQL}, forms AS (SELECT anomer, superclass, ring_start, ring_end, stems, configs, mods, list_sort(substituents) AS bag, min(residue) AS id FROM res GROUP BY ALL)"
ORDERS = FORMS + f", orders_ AS (SELECT DISTINCT a.*, r.substituents, list_transform(r.substituents, lambda s: split_part(s, '/', 3)) AS kinds FROM forms a JOIN res r ON list_sort(r.substituents) = a.bag AND {SAME.replace('b.', 'r.')})"
MAY = "(a.{0} IS NULL OR b.{0} IS NULL OR a.{0} = b.{0})"
HAS = "(b.{0} IS NULL OR a.{0} IS NOT DISTINCT FROM b.{0})"


def listed(test: str, name: str) -> str:
    """A test of both elements of lists of one length."""
    return f"len(a.{name}) = len(b.{name}) AND " + " AND ".join(test.format(f"{name}[{k}]") for k in (1, 2))


def given(spark, d):
    return derived.table(spark, d, "orders").selectExpr(
        "o_orderkey as residue", "case (o_orderkey + o_custkey) % 5 when 0 then null when 1 then 'a' else 'b' end as anomer", "case o_custkey % 7 when 0 then null when 1 then 'NON' else 'HEX' end as superclass",
        "case when o_custkey % 11 < 3 then null else 1 end as ring_start", "case o_orderkey % 4 when 0 then null when 1 then 4 else 5 end as ring_end",
        "case when o_custkey % 7 = 1 then array('gro', case o_orderkey % 3 when 0 then null else 'gal' end) else array(case o_custkey % 5 when 0 then null when 1 then 'glc' else 'man' end) end as stems",
        "case when o_custkey % 7 = 1 then array('d', null) when o_custkey % 3 = 0 then array(cast(null as string)) else array('d') end as configs",
        "case o_custkey % 4 when 0 then array('6:d') when 1 then array('?:d') else cast(array() as array<string>) end as mods",
        "case o_orderkey % 5 when 0 then array('2/lost/nAcetyl') when 1 then array('2/lost/nAcetyl', '6/kept/sulfate') when 2 then array('6/kept/sulfate', '2/lost/nAcetyl') when 3 then array('3/lost/nAcetyl') else cast(array() as array<string>) end as substituents",
    )


@query("residue_classes", f"WITH {FORMS} SELECT residue, id FROM res a JOIN forms b ON list_sort(a.substituents) = b.bag AND {SAME}")
def residue_classes(spark, d):
    return ops.classes(given(spark, d), "residue")[0]


@query("residue_class_compatible", f"WITH {ORDERS} SELECT DISTINCT a.id AS a, b.id AS b FROM orders_ a JOIN orders_ b ON a.id <= b.id AND a.mods = b.mods AND a.kinds = b.kinds AND {' AND '.join(MAY.format(c) for c in ops.SCALARS)} AND {listed(MAY, 'stems')} AND {listed(MAY, 'configs')}")
def residue_class_compatible(spark, d):
    return ops.compatible(ops.classes(given(spark, d), "residue")[1])


def has(*names: str) -> str:
    return "SELECT a.id AS a, b.id AS b FROM forms a JOIN forms b ON a.mods = b.mods AND a.bag = b.bag AND " + " AND ".join(listed(HAS, c) if c in ("stems", "configs") else HAS.format(c) for c in names)


@query("residue_class_compatible_with", f"WITH {FORMS} {has(*ops.SCALARS, 'stems', 'configs')}")
def residue_class_compatible_with(spark, d):
    return ops.compatible_with(ops.classes(given(spark, d), "residue")[1])


@query("residue_class_visible", f"WITH {FORMS} {has('anomer', 'superclass', 'stems')}")
def residue_class_visible(spark, d):
    return ops.compatible_with(ops.classes(given(spark, d), "residue")[1], visible_only=True)


@query("residue_class_visible_root", f"WITH {FORMS} {has('superclass', 'stems')}")
def residue_class_visible_root(spark, d):
    return ops.compatible_with(ops.classes(given(spark, d), "residue")[1], root=True, visible_only=True)


@query("residue_determined", f"WITH {SQL} SELECT residue, anomer IS NOT NULL AND superclass IS NOT NULL AND ring_start IS NOT NULL AND ring_end IS NOT NULL AND len(list_filter(stems, lambda s: s IS NULL)) = 0 AND len(list_filter(configs, lambda s: s IS NULL)) = 0 AND len(list_filter(mods, lambda m: m LIKE '?%')) = 0 AS determined FROM res")
def residue_determined(spark, d):
    rows = given(spark, d)
    return rows.select("residue", ops.determined(rows).alias("determined"))


@query("residue_predicates", """WITH r AS (SELECT o_orderkey AS residue, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS ring_start, CASE o_orderkey % 3 WHEN 0 THEN 0 ELSE 5 END AS ring_end,
  CASE o_custkey % 4 WHEN 0 THEN ['6:d'] WHEN 1 THEN ['3:d', '6:d', '1:aldi'] WHEN 2 THEN ['?:keto', '1:a'] ELSE [] END AS mods FROM orders),
k AS (SELECT residue, split_part(unnest(mods), ':', 2) AS kind FROM r), c AS (SELECT residue, kind, count(*) AS n FROM k GROUP BY ALL)
SELECT residue, coalesce(ring_start = 0 AND ring_end = 0, FALSE) AS noring, kind, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (residue)""")
def residue_predicates(spark, d):
    """Residues without a ring and the number of each kind of modification."""
    return ops.predicates(derived.table(spark, d, "orders").selectExpr(
        "o_orderkey as residue", "case o_custkey % 5 when 0 then null when 1 then 0 else 1 end as ring_start", "case o_orderkey % 3 when 0 then 0 else 5 end as ring_end",
        "case o_custkey % 4 when 0 then array('6:d') when 1 then array('3:d', '6:d', '1:aldi') when 2 then array('?:keto', '1:a') else cast(array() as array<string>) end as mods",
    ))


@query("residue_listing", f"""WITH {NODES}, l AS (SELECT glycan_id, parent, node AS child, NOT (glycan_id % 5 = 0 AND node = 4) AS settled FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT glycan_id, 1, 4, FALSE FROM nodes WHERE glycan_id % 5 = 0 AND node = 4 AND parent <> 1),
e AS (SELECT glycan_id, parent AS node, TRUE AS down, child AS other, settled FROM l UNION ALL SELECT glycan_id, child, FALSE, parent, settled FROM l)
SELECT n.glycan_id, n.node, coalesce(string_agg(CASE WHEN settled THEN '->' ELSE '~>' END || other, ',' ORDER BY other, settled) FILTER (NOT down), '') AS parents, coalesce(string_agg(CASE WHEN settled THEN '->' ELSE '~>' END || other, ',' ORDER BY other, settled) FILTER (down), '') AS children
FROM nodes n LEFT JOIN e ON e.glycan_id = n.glycan_id AND e.node = n.node GROUP BY 1, 2""")
def residue_listing(spark, d):
    """Every residue's parents and children with the state of each link; one node in five glycans has two possible parents."""
    n = derived.nodes(spark, d)
    open_ = "glycan_id % 5 = 0 and node = 4"
    tree = n.filter("parent is not null").selectExpr("glycan_id", "parent", "node as child", f"not ({open_}) as settled")
    return ops.listing(n, tree.unionByName(n.filter(f"{open_} and parent <> 1").selectExpr("glycan_id", "1L as parent", "node as child", "false as settled")))
