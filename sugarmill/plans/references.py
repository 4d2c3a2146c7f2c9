"""Queries over reference tables that are read from text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sugarmill.functions.lineage import shared_dir
from sugarmill.operators import references as ops
from sugarmill.plans.base import NODES, query
from sugarmill.sources import derived, facts

# Lines of three palettes.
STANDARD = """black_lower = 0,0,0
black_upper = 180,171,235
red_lower_l =0,18,120
red_upper_l =19,255,255
yellow_lower = 20,62,104
yellow_upper = 36,255,255
green_lower =37,40,70
green_upper =77,255,255
blue_lower =87,40,60
blue_upper =134,255,255
purple_lower = 135,20,40
purple_upper = 169,255,225
red_lower_h =156,40,120
red_upper_h =180,255,255"""
FOUR = """yellow_lower = 22,62,104
yellow_upper = 38,255,255
black_lower = 0,0,0
black_upper = 180,171,235
purple_lower = 135,18,46
purple_upper = 169,255,190
red_lower_l =0,18,120
red_upper_l =19,255,255
red_lower_h =156,40,120
red_upper_h =180,255,255
green_lower =62,0,0
green_upper =74,255,255
blue_lower =110,26,0
blue_upper =150,255,255"""
BACKUP = """yellow_lower = 22,62,104
yellow_upper = 38,255,255
black_lower = 0,0,0
black_upper = 180,171,235
purple_lower = 135,18,46
purple_upper = 169,255,190
red_lower_l =0,18,120
red_upper_l =19,255,255
red_lower_h =156,40,120
red_upper_h =180,255,255
green_lower =38,91,120
green_upper =72,255,255
blue_lower =97,62,116
blue_upper =132,255,255"""
# Codes of constants.
CONSTANTS = [
    ("Anomer", "alpha", 1), ("Anomer", "beta", 2), ("Anomer", "uncyclized", 3), ("SuperClass", "TRI", 3), ("SuperClass", "TETRA", 4), ("SuperClass", "PENT", 5),
    ("SuperClass", "HEX", 6), ("SuperClass", "HEPT", 7), ("SuperClass", "OCT", 8), ("SuperClass", "NON", 9), ("SuperClass", "DEC", 10),
]
LINES = [(name, line) for name, text in (("standard", STANDARD), ("four", FOUR), ("backup", BACKUP)) for line in text.split("\n")]
#: The same reading in SQL.
RANGES = facts.values("colour_lines", "palette, value", LINES) + """, sides AS (SELECT palette, string_split(trim(split_part(value, '=', 1)), '_') AS name, string_split(trim(split_part(value, '=', 2)), ',') AS nums FROM colour_lines),
bounds AS (SELECT palette, name[1] AS colour, coalesce(name[3], '') AS half, max(nums) FILTER (name[2] = 'lower') AS lo, max(nums) FILTER (name[2] = 'upper') AS hi FROM sides GROUP BY ALL),
ranges AS (SELECT palette, colour, half, lo[1]::INT AS h_lo, lo[2]::INT AS s_lo, lo[3]::INT AS v_lo, hi[1]::INT AS h_hi, hi[2]::INT AS s_hi, hi[3]::INT AS v_hi FROM bounds),
px AS (SELECT event_id, event_id * 7 % 181 AS h, event_id * 13 % 256 AS s, event_id * 29 % 256 AS v FROM events),
hit AS (SELECT * FROM px JOIN ranges ON h BETWEEN h_lo AND h_hi AND s BETWEEN s_lo AND s_hi AND v BETWEEN v_lo AND v_hi)"""


def ranges(spark):
    """The palettes, written as text files to the shared folder, one folder for each, and read again."""
    path = f"{shared_dir(spark)}/palettes-{uuid.uuid4().hex}"
    spark.createDataFrame(LINES, "palette string, value string").write.partitionBy("palette").text(path)
    return ops.colour_ranges(spark.read.schema("value string, palette string").text(path), "palette")


def hits(spark, d):
    px = derived.table(spark, d, "events").selectExpr("event_id", "event_id * 7 % 181 as h", "event_id * 13 % 256 as s", "event_id * 29 % 256 as v")
    return ops.colours_of(px, ranges(spark))


@query("dim_color", f"WITH {RANGES} SELECT h_lo, s_lo, v_lo, h_hi, s_hi, v_hi, colour, half, count(*) AS n FROM hit WHERE palette = 'standard' GROUP BY ALL")
def dim_color(spark, d):
    return hits(spark, d).filter("palette = 'standard'").groupBy("h_lo", "s_lo", "v_lo", "h_hi", "s_hi", "v_hi", "colour", "half").agg(F.count("*").alias("n"))


@query("dim_color_palettes", f"WITH {RANGES} SELECT palette, colour, count(*) AS n FROM hit GROUP BY ALL")
def dim_color_palettes(spark, d):
    return hits(spark, d).groupBy("palette", "colour").agg(F.count("*").alias("n"))


@query("constant_lookup", f"""WITH {NODES}, {facts.values("constants", "kind, constant, code", CONSTANTS)},
named AS (SELECT glycan_id, node, class_id + 2 AS superclass_code, 'Anomer.' || CASE WHEN anomer = 'a' THEN 'alpha' WHEN node = 3 THEN 'other' ELSE 'beta' END AS anomer_name FROM nodes)
SELECT n.glycan_id, n.node, n.anomer_name, a.code AS anomer_code, n.superclass_code, coalesce(s.constant, n.superclass_code::VARCHAR) AS superclass
FROM named n LEFT JOIN constants a ON a.kind || '.' || a.constant = n.anomer_name LEFT JOIN constants s ON s.kind = 'SuperClass' AND s.code = n.superclass_code""")
def constant_lookup(spark, d):
    known = spark.createDataFrame(CONSTANTS, "kind string, constant string, code int")
    n = derived.nodes(spark, d).selectExpr("glycan_id", "node", "class_id + 2 as superclass_code", "concat('Anomer.', case when anomer = 'a' then 'alpha' when node = 3 then 'other' else 'beta' end) as anomer_name")
    return ops.constant_name(known, ops.constant_code(known, n, "anomer_name", "anomer_code"), "SuperClass", "superclass_code", "superclass")


@query("reference_duplicates", "SELECT c_nationkey, c_custkey % 100 AS code, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def reference_duplicates(spark, d):
    return ops.duplicate_keys(derived.table(spark, d, "customer"), F.col("c_nationkey"), (F.col("c_custkey") % 100).alias("code"))
