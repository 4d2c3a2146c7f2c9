"""Queries over text forms and fixed fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import textforms as ops
from sugarmill.plans import files
from sugarmill.plans.base import NODES, SYMBOL, TRUTH, query
from sugarmill.plans.composition import GSYM, RES, residues
from sugarmill.sources import derived, facts
from sugarmill.sources import files as sources



@query("scan_truth", f"WITH {TRUTH} SELECT image_id, class_id, (x + w // 2) / 640::DOUBLE AS rel_cen_x, (y + h // 2) / 400::DOUBLE AS rel_cen_y, w / 640::DOUBLE AS rel_w, h / 400::DOUBLE AS rel_h FROM truth WHERE box_id % 9 <> 0")
def scan_truth(spark, d):
    return ops.truth_rows(files.image_of(sources.folder_lines(spark, files.label_files(spark, d), "txt", deep=True)), "image_id")


@query("scan_truth_composition", f"WITH {TRUTH}, {SYMBOL} SELECT image_id, symbol, count(*)::INT AS n FROM truth JOIN dim_symbol USING (class_id) GROUP BY ALL")
def scan_truth_composition(spark, d):
    return ops.composition_rows(files.image_of(sources.folder_lines(spark, files.log_files(spark, d), "log", deep=True)), "image_id")


@query("sidecar_pairs", "SELECT p.page_id, p.name, o.o_orderkey AS log_id FROM (SELECT page_id, page_id || '.a.png' AS name FROM pages) p JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE '' END || o_orderkey || '.log' AS log FROM orders) o ON split_part(p.name, '.', 1) = split_part(o.log, '.', 1)")
def sidecar_pairs(spark, d):
    p, o = sidecars(spark, d)
    return p.join(o, "stem").select("page_id", "name", F.col("o_orderkey").alias("log_id"))


def sidecars(spark, d):
    stem = lambda c: F.split(c, "\\.")[0].alias("stem")
    p = derived.table(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".a.png")).alias("name")).select("*", stem("name"))
    o = derived.table(spark, d, "orders").select("o_orderkey", F.expr("concat(if(o_orderkey % 7 = 0, 'old', ''), o_orderkey, '.log')").alias("log")).select("*", stem("log"))
    return p, o


@query("sidecar_missing", "SELECT page_id, page_id || '.a.png' AS name FROM pages WHERE page_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def sidecar_missing(spark, d):
    p, o = sidecars(spark, d)
    return p.join(o, "stem", "left_anti").select("page_id", "name")


DOCS = f"""{NODES}, keys(class_id, body) AS (VALUES {', '.join(f"({k}, '{s[2]}-{s[1]}')" for k, s in enumerate(facts.SYMBOL_KEYS))}),
resl AS (SELECT glycan_id, node + 1 AS residue, (node + 1) || 'b:' || anomer || '-' || body AS line FROM nodes JOIN keys USING (class_id)),
linl AS (SELECT glycan_id, node AS link, node || ':' || CASE WHEN glycan_id % 17 = 1 AND node = 1 THEN 99 WHEN glycan_id % 17 = 2 AND node = 2 THEN node + 2 ELSE parent + 1 END || 'o(' || CASE WHEN glycan_id % 5 = 0 THEN -1 ELSE parent_pos END || '+1)' || (node + 1) || 'd' || CASE WHEN glycan_id % 17 = 3 AND node = 1 THEN '?' ELSE '' END AS line FROM nodes WHERE parent IS NOT NULL)"""


def pieces(spark, d):
    n = derived.nodes(spark, d).join(facts.small(spark, [(k, f"{s[2]}-{s[1]}") for k, s in enumerate(facts.SYMBOL_KEYS)], "class_id int, body string"), "class_id")
    res = n.select("glycan_id", (F.col("node") + 1).alias("residue"), F.expr("concat(node + 1, 'b:', anomer, '-', body)").alias("line"))
    parent = "case when glycan_id % 17 = 1 and node = 1 then 99 when glycan_id % 17 = 2 and node = 2 then node + 2 else parent + 1 end"
    line = f"concat(node, ':', {parent}, 'o(', case when glycan_id % 5 = 0 then -1 else parent_pos end, '+1)', node + 1, 'd', case when glycan_id % 17 = 3 and node = 1 then '?' else '' end)"
    return res, n.filter("parent is not null").select("glycan_id", F.col("node").alias("link"), F.expr(line).alias("line"))


def docs(spark, d):
    return ops.structure_text(*pieces(spark, d), "glycan_id")


@query("glycoct_text", f"WITH {DOCS} SELECT r.glycan_id, 'RES' || chr(10) || string_agg(DISTINCT r.t, '') || coalesce(chr(10) || 'LIN' || chr(10) || max(l.t), '') AS text FROM (SELECT glycan_id, string_agg(line, chr(10) ORDER BY residue) AS t FROM resl GROUP BY 1) r LEFT JOIN (SELECT glycan_id, string_agg(line, chr(10) ORDER BY link) AS t FROM linl GROUP BY 1) l USING (glycan_id) GROUP BY 1")
def glycoct_text(spark, d):
    return docs(spark, d)


@query("glycoct_residues", f"WITH {DOCS} SELECT glycan_id, (node + 1)::INT AS residue, 'b' AS kind, anomer, body FROM nodes JOIN keys USING (class_id)")
def glycoct_residues(spark, d):
    return ops.structure_residues(docs(spark, d), "glycan_id", "text")


@query("glycoct_links", f"WITH {DOCS} SELECT glycan_id, node::INT AS link, (CASE WHEN glycan_id % 17 = 1 AND node = 1 THEN 99 WHEN glycan_id % 17 = 2 AND node = 2 THEN node + 2 ELSE parent + 1 END)::INT AS parent, 'o' AS parent_type, CASE WHEN glycan_id % 5 = 0 THEN NULL ELSE parent_pos END AS parent_pos, 1 AS child_pos, (node + 1)::INT AS child, 'd' AS child_type FROM nodes WHERE parent IS NOT NULL AND NOT (glycan_id % 17 = 3 AND node = 1)")
def glycoct_links(spark, d):
    return ops.structure_links(docs(spark, d), "glycan_id", "text")


@query("glycoct_rejects", f"WITH {DOCS}, damaged AS (SELECT glycan_id, bool_or(parent IS NOT NULL AND node = 1) AS one, bool_or(parent IS NOT NULL AND node = 2) AS two, bool_or(node = 3) AS four FROM nodes GROUP BY 1) SELECT glycan_id, CASE WHEN glycan_id % 17 = 3 AND one THEN 'bad line' WHEN glycan_id % 17 = 1 AND one THEN 'parent missing' WHEN glycan_id % 17 = 2 AND two AND NOT four THEN 'parent missing' WHEN glycan_id % 17 = 2 AND two THEN 'backwards link' END AS reason FROM damaged WHERE (glycan_id % 17 IN (1, 3) AND one) OR (glycan_id % 17 = 2 AND two)")
def glycoct_rejects(spark, d):
    # links may also name a parent whose row the tables lack; those glycans are left out on both sides by taking whole trees only
    return ops.structure_rejects(docs(spark, d), "glycan_id", "text")


@query("residue_text", f"WITH {GSYM} SELECT g.glycan_id, g.node, g.anomer || '-' || k.stem || '-' || k.superclass || CASE WHEN k.mods = '' THEN '' ELSE '|' || k.mods END || CASE WHEN k.substituents = '' THEN '' ELSE '(' || k.substituents || ')' END AS text FROM gs g JOIN symbol_keys k USING (symbol)")
def residue_text(spark, d):
    g = derived.nodes(spark, d).join(derived.dim_symbol(spark), "class_id").join(facts.symbol_keys(spark), "symbol")
    return g.select("glycan_id", "node", F.concat("anomer", F.lit("-"), "stem", F.lit("-"), "superclass", F.when(F.col("mods") == "", "").otherwise(F.concat(F.lit("|"), "mods")), F.when(F.col("substituents") == "", "").otherwise(F.concat(F.lit("("), "substituents", F.lit(")")))).alias("text"))


@query("residue_flags", f"WITH {GSYM} SELECT g.glycan_id, g.node, CASE WHEN k.mods = '' THEN 0 ELSE len(string_split(k.mods, '|')) END::INT AS n_mods, k.mods <> '' AS has_mods, k.substituents = 'n-acetyl' AS is_n_acetylated, k.substituents NOT IN ('', 'n-acetyl') AS other_substituents FROM gs g JOIN symbol_keys k USING (symbol)")
def residue_flags(spark, d):
    g = derived.nodes(spark, d).join(derived.dim_symbol(spark), "class_id").join(facts.symbol_keys(spark), "symbol")
    mods = F.filter(F.split("mods", "\\|"), lambda m: m != "")
    return g.select("glycan_id", "node", F.size(mods).alias("n_mods"), (F.size(mods) > 0).alias("has_mods"), (F.col("substituents") == "n-acetyl").alias("is_n_acetylated"), (~F.col("substituents").isin("", "n-acetyl")).alias("other_substituents"))


@query("alias_resolution", f"WITH {facts.SQL_ALIASES}, n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Neu5Ac' WHEN 1 THEN 'Mannose' WHEN 2 THEN 'Gal' ELSE 'Unknown' END AS name FROM customer) SELECT n.c_custkey, n.name, coalesce(a.symbol, CASE WHEN n.name = 'Gal' THEN 'Gal' END) AS symbol FROM n LEFT JOIN aliases a ON a.alias = n.name")
def alias_resolution(spark, d):
    n = derived.table(spark, d, "customer").selectExpr("c_custkey", "case c_custkey % 4 when 0 then 'Neu5Ac' when 1 then 'Mannose' when 2 then 'Gal' else 'Unknown' end as name")
    known = facts.small(spark, [*facts.ALIASES, *((s, s) for s in derived.SYMBOLS)], "name string, symbol string")
    return n.join(known, "name", "left").select("c_custkey", "name", "symbol")


@query("symbol_element_use", f"WITH {RES} SELECT r.element, count(*) AS residues, sum(r.native)::BIGINT AS atoms, max(e.mono) AS mono FROM gs g JOIN res r USING (symbol) JOIN elements e USING (element) GROUP BY 1")
def symbol_element_use(spark, d):
    g = derived.nodes(spark, d).join(derived.dim_symbol(spark), "class_id").join(F.broadcast(residues(spark)), "symbol").join(facts.elements(spark), "element")
    return g.groupBy("element").agg(F.count("*").alias("residues"), F.sum("native").alias("atoms"), F.max("mono").alias("mono"))
