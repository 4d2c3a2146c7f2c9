"""Queries over WURCS 2.0 texts, derived from the glycan trees, with the cases that a reader meets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.functions.lineage import cut
from sugarmill.operators import wurcs as ops
from sugarmill.plans.base import NODES, query
from sugarmill.sources import derived

#: Codes of residues: skeleton, ring, substituents; then what they decode to: superclass, stems, configurations, modifications, substituents, reason.
UNITS = [
    ("a2122h", "1-5", "_2*NCC/3=O", "HEX", "glc", "d", "", "2:nAcetyl:oxygenLost", ""), ("Aad21122h", "2-6", "_5*NCC/3=O", "NON", "gro,gal", "d,d", "1:a,2:keto,3:d", "5:nAcetyl:oxygenLost", ""),
    ("a1221m", "1-5", "", "HEX", "gal", "l", "6:d", "", ""), ("a1122h", "1-5", "", "HEX", "man", "d", "", "", ""), ("a2112h", "1-5", "_3*OSO/3=O/3=O_6*OSO/3=O/3=O", "HEX", "gal", "d", "", "3:sulfate:oxygenPreserved,6:sulfate:oxygenPreserved", ""),
    ("a2112h", "1-4", "", "HEX", "gal", "d", "", "", ""), ("axxxxh", "1-5", "_2*NCC/3=O", "HEX", "", "", "", "2:nAcetyl:oxygenLost", ""), ("Aad21122h", "2-6", "_?*NCCO/3=O", "NON", "gro,gal", "d,d", "1:a,2:keto,3:d", "?:nglycolyl:oxygenLost", ""),
    ("a2122A", "?-?", "", "HEX", "glc", "d", "6:a", "", ""), ("a1122xh", "1-5", "_6|7*OCC/3=O", "HEPT", "gro,man", "?,d", "", "6|7:acetyl:oxygenPreserved", ""), ("a4344h", "1-5", "", "HEX", "glc", "?", "", "", ""),
    ("ha122h", "2-5", "", "HEX", "ara", "d", "2:keto", "", ""), ("a21EEA", "1-5", "", "HEX", "thr", "l", "4-5:enx,6:a", "", ""), ("ad112m", "1-5", "", "HEX", "lyx", "d", "2:d,6:d", "", ""),
    ("a2112h", "1-5", "_3-6", "HEX", "gal", "d", "", "3:anhydro:oxygenLost,6:anhydro:oxygenPreserved", ""), ("a2d12m", "1-5", "_4*NC/2C", "HEX", "xyl", "d", "3:d,6:d", "4:ndimethyl:oxygenLost", ""),
    ("a2122h", "1-5", "_2*QQ", "", "", "", "", "", "unsupported substituent"), ("a2b22h", "1-5", "", "", "", "", "", "", "unsupported skeleton"), ("a12", "1-5", "_1+2", "", "", "", "", "", "bad code"),
]
LETTERS = "abx"
SUGAR = f"unit_list(no, skeleton, ring, added, superclass, stems, configs, mods, substituents, reason) AS (VALUES {', '.join(str((k, *u)) for k, u in enumerate(UNITS))})"
#: Texts: glycan_id % 19 names the odd case, if any; residue 1 has no parent.
TEXTS = f"""{NODES}, {SUGAR},
res AS (SELECT glycan_id, node + 1 AS residue, parent + 1 AS parent, parent_pos, CASE WHEN class_id IN (1, 7) THEN 2 ELSE 1 END AS child_pos, (class_id * 5 + node * 3 + glycan_id) % {len(UNITS)} AS no, substr('{LETTERS}', ((glycan_id + node) % 3)::INT + 1, 1) AS letter, glycan_id % 19 AS odd FROM nodes),
coded AS (SELECT res.*, skeleton || '-' || CASE WHEN ring = '2-6' OR ring = '2-5' THEN '2' ELSE '1' END || letter || '_' || ring || added AS unit FROM res JOIN unit_list USING (no))"""
LINKS = """link AS (SELECT glycan_id, residue - 1 AS link, CASE WHEN odd = 1 AND residue = 3 THEN 'parents' WHEN odd = 2 AND residue = 3 THEN 'positions' WHEN odd = 9 AND residue = 2 THEN 'bridge' ELSE 'simple' END AS kind,
  unnest(CASE WHEN odd = 1 AND residue = 3 THEN [{'p': 1, 'q': [3], 'c': 3, 'd': child_pos}, {'p': 2, 'q': [4], 'c': 3, 'd': child_pos}] WHEN odd = 2 AND residue = 3 THEN [{'p': parent, 'q': [3, 6], 'c': 3, 'd': child_pos}]
    WHEN odd = 3 AND residue = 2 THEN [{'p': 1, 'q': NULL, 'c': 2, 'd': child_pos}] WHEN odd = 9 AND residue = 2 THEN [{'p': 1, 'q': [3], 'c': 2, 'd': child_pos}] WHEN odd = 11 AND residue = 2 THEN [{'p': 2, 'q': [4], 'c': 1, 'd': 1}]
    ELSE [{'p': parent, 'q': [parent_pos], 'c': residue, 'd': child_pos}] END) AS e FROM coded WHERE parent IS NOT NULL AND odd NOT IN (7, 10) AND NOT (odd IN (5, 6) AND residue = 2))"""


def coded(spark, d):
    """(glycan_id, residue, parent, parent_pos, child_pos, unit, odd)."""
    units = F.broadcast(spark.createDataFrame([(k, *u[:3]) for k, u in enumerate(UNITS)], "no long, skeleton string, ring string, added string"))
    rows = derived.nodes(spark, d).selectExpr(
        "glycan_id", "node + 1 as residue", "parent + 1 as parent", "parent_pos", "if(class_id in (1, 7), 2, 1) as child_pos", f"(class_id * 5 + node * 3 + glycan_id) % {len(UNITS)} as no",
        f"substr('{LETTERS}', cast((glycan_id + node) % 3 as int) + 1, 1) as letter", "glycan_id % 19 as odd",
    )
    return rows.join(units, "no").withColumn("unit", F.expr("concat(skeleton, '-', if(ring in ('2-6', '2-5'), '2', '1'), letter, '_', ring, added)"))


def texts(spark, d):
    """(glycan_id, text)."""
    rows = coded(spark, d)
    low = lambda c: ops.lettered(F.col(c))
    case = lambda odd, residue, *text: F.when((F.col("odd") == odd) & (F.col("residue") == residue), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text)))
    cp, p, everyone = F.col("child_pos").cast("string"), low("parent"), "a?|b?|c?|d?|e?|f?|g?|h?"
    line = F.coalesce(
        case(1, 3, "c", cp, "-a3|b4}"), case(2, 3, "c", cp, "-", p, "3|", p, "6"), case(3, 2, "a?-b", cp), case(5, 2, "a3-b4"), case(6, 2, "b1-a3"), case(9, 2, "a3-b", cp, "*OPO*/3O/3=O"), case(11, 2, "a1-b4"),
        F.when(F.col("odd") == 10, f"{everyone}}}-{{{everyone}"), F.concat(p, F.col("parent_pos").cast("string"), F.lit("-"), low("residue"), cp),
    )
    seq = F.array_sort(F.collect_list(F.struct("residue", "unit", "parent", line.alias("line"))))
    all_ = rows.groupBy("glycan_id").agg(F.first("odd").alias("odd"), seq.alias("seq")).withColumn("units", F.array_distinct(F.transform("seq", lambda x: x["unit"])))
    lines = F.concat(F.transform(F.filter("seq", lambda x: x["parent"].isNotNull()), lambda x: x["line"]), F.when(F.col("odd") == 10, F.array(F.lit(f"{everyone}}}*OSO/3=O/3=O"))).otherwise(F.array().cast("array<string>")))
    counts = F.concat_ws(",", F.size("units").cast("string"), F.size("seq").cast("string"), (F.size(lines) + F.when(F.col("odd") == 4, 1).otherwise(0)).cast("string"))
    places = F.array_join(F.transform("seq", lambda x: F.array_position("units", x["unit"]).cast("string")), "-")
    head = F.when(F.col("odd") == 7, "WURCS=1.0/").otherwise("WURCS=2.0/")
    return all_.select("glycan_id", F.concat(head, counts, F.when(F.col("odd") == 8, "+").otherwise(""), F.lit("/["), F.array_join("units", "]["), F.lit("]/"), places, F.lit("/"), F.array_join(lines, "_")).alias("text"))


@query("wurcs_residues", f"WITH {TEXTS} SELECT glycan_id, residue::INT AS residue, unit FROM coded WHERE odd <> 7")
def wurcs_residues(spark, d):
    return ops.residues(texts(spark, d), "glycan_id", "text")


@query("wurcs_links", f"WITH {TEXTS}, {LINKS} SELECT glycan_id, link::INT AS link, kind, e.p::INT AS parent, array_to_string(e.q, '|') AS parent_pos, e.c::INT AS child, e.d::INT AS child_pos, CASE WHEN kind = 'bridge' THEN 'OPO/3O/3=O' END AS bridge, kind = 'parents' AS undetermined FROM link")
def wurcs_links(spark, d):
    return ops.links(texts(spark, d), "glycan_id", "text").withColumn("parent_pos", F.array_join(F.col("parent_pos").cast("array<string>"), "|"))


@query("wurcs_floating", f"WITH {TEXTS} SELECT DISTINCT glycan_id, 8 AS link, 'OSO/3=O/3=O' AS substituent FROM coded WHERE odd = 10")
def wurcs_floating(spark, d):
    return ops.floating(texts(spark, d), "glycan_id", "text")


@query("wurcs_rejects", f"WITH {TEXTS} SELECT DISTINCT glycan_id, CASE odd WHEN 7 THEN 'bad form' WHEN 8 THEN 'open link count' WHEN 6 THEN 'wrong order' WHEN 5 THEN 'unsupported link' ELSE 'link count' END AS reason FROM coded WHERE odd IN (4, 5, 6, 7, 8)")
def wurcs_rejects(spark, d):
    return ops.rejects(texts(spark, d), "glycan_id", "text")


@query("wurcs_unique_residues", f"""WITH {TEXTS}, u AS (SELECT DISTINCT unit, letter, no FROM coded WHERE odd <> 7)
SELECT unit, CASE WHEN reason = '' AND letter <> 'x' THEN CASE letter WHEN 'a' THEN 'alpha' ELSE 'beta' END END AS anomer, CASE WHEN reason = '' THEN TRY_CAST(split_part(ring, '-', 1) AS INT) END AS ring_start, CASE WHEN reason = '' THEN TRY_CAST(split_part(ring, '-', 2) AS INT) END AS ring_end,
  CASE WHEN reason = '' THEN superclass END AS superclass, CASE WHEN reason = '' THEN stems END AS stems, CASE WHEN reason = '' THEN configs END AS configs, CASE WHEN reason = '' THEN mods END AS mods, CASE WHEN reason = '' THEN substituents END AS substituents, nullif(reason, '') AS reason FROM u JOIN unit_list USING (no)""")
def wurcs_unique_residues(spark, d):
    rows = ops.decoded(ops.residues(texts(spark, d), "glycan_id", "text"))
    known = lambda c, unknown: F.array_join(c, ",", unknown)
    mods = F.transform("mods", lambda m: F.concat(m["pos"].cast("string"), F.coalesce(F.concat(F.lit("-"), m["to"].cast("string")), F.lit("")), F.lit(":"), m["mod"]))
    subs = F.transform("substituents", lambda s: F.concat_ws(":", F.coalesce(F.array_join(s["positions"].cast("array<string>"), "|"), F.lit("?")), s["kind"], s["link"]))
    return rows.select("unit", "anomer", "ring_start", "ring_end", "superclass", known("stems", "?").alias("stems"), known("configs", "?").alias("configs"), F.array_join(mods, ",").alias("mods"), F.array_join(subs, ",").alias("substituents"), "reason")


@query("wurcs_round_trip", f"WITH {TEXTS} SELECT DISTINCT glycan_id, TRUE AS same FROM coded WHERE odd NOT IN (4, 5, 6, 7, 8, 10)")
def wurcs_round_trip(spark, d):
    """Texts that can be read and link all residues, written again from what was read."""
    given = cut(texts(spark, d))
    whole = cut(given.join(ops.rejects(given, "glycan_id", "text"), "glycan_id", "left_anti").join(ops.floating(given, "glycan_id", "text"), "glycan_id", "left_anti"))
    back = ops.written(ops.residues(whole, "glycan_id", "text"), ops.links(whole, "glycan_id", "text"), "glycan_id")
    return whole.join(back.withColumnRenamed("text", "again"), "glycan_id", "left").select("glycan_id", F.col("text").eqNullSafe(F.col("again")).alias("same"))
