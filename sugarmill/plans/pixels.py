"""Queries over pixels painted from the truth boxes at a tenth of their size."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import detections
from sugarmill.operators import pixels as ops
from sugarmill.plans.base import TRUTH, query
from sugarmill.sources import derived, facts

PIX = f"""{TRUTH}, {facts.SQL_COLOURS}, painted AS (SELECT image_id, CAST(y // 10 + dy AS INT) AS y, CAST(x // 10 + dx AS INT) AS x, max(class_id) AS c FROM (SELECT *, unnest(range(w // 10)) AS dx FROM (SELECT *, unnest(range(h // 10)) AS dy FROM truth)) GROUP BY ALL),
pix AS (SELECT image_id, y, x, CAST(CASE c WHEN 0 THEN 200 WHEN 1 THEN 160 WHEN 3 THEN 60 WHEN 6 THEN 210 WHEN 7 THEN 235 ELSE 20 END AS INT) AS b, CAST(CASE c WHEN 0 THEN 90 WHEN 1 THEN 30 WHEN 3 THEN 150 WHEN 4 THEN 210 WHEN 5 THEN 205 WHEN 6 THEN 100 WHEN 7 THEN 220 ELSE 25 END AS INT) AS g,
  CAST(CASE c WHEN 0 THEN 10 WHEN 1 THEN 140 WHEN 2 THEN 220 WHEN 3 THEN 10 WHEN 4 THEN 240 WHEN 5 THEN 235 WHEN 6 THEN 15 ELSE 140 END AS INT) AS r FROM painted),
q AS (SELECT *, greatest(b, g, r) AS v, least(b, g, r) AS lo FROM pix),
hue AS (SELECT *, CASE WHEN v = lo THEN 0 WHEN r = v THEN 30 * ((g - b) / (v - lo)::DOUBLE) WHEN g = v THEN 30 * (2 + (b - r) / (v - lo)::DOUBLE) ELSE 30 * (4 + (r - g) / (v - lo)::DOUBLE) END AS hh FROM q),
hsv AS (SELECT image_id, y, x, CAST(floor(CASE WHEN hh < 0 THEN hh + 180 ELSE hh END + 0.5) AS INT) AS h, CAST(CASE WHEN v = 0 THEN 0 ELSE floor(255 * (v - lo)::DOUBLE / v + 0.5) END AS INT) AS s, v FROM hue),
col AS (SELECT DISTINCT image_id, y, x, colour FROM hsv JOIN colours ON h BETWEEN h_lo AND h_hi AND s BETWEEN s_lo AND s_hi AND v BETWEEN v_lo AND v_hi)"""
#: Regions by propagating the smallest label over touching pixels.
REG = PIX + """, lab AS (SELECT image_id, colour, y, x, y::BIGINT * 100000 + x AS id FROM col WHERE colour <> 'black'),
runs0 AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, colour, y ORDER BY x) AS gap FROM lab),
runs AS (SELECT image_id, colour, y, min(x) AS x1, max(x) AS x2, count(*) AS n, y::BIGINT * 100000 + min(x) AS label FROM runs0 GROUP BY image_id, colour, y, gap),
touch AS (SELECT a.image_id, a.colour, a.label AS a, b.label AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.colour = b.colour AND abs(a.y - b.y) = 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1),
spread AS (SELECT image_id, colour, label, label AS other FROM runs UNION SELECT s.image_id, s.colour, s.label, t.b FROM spread s JOIN touch t ON t.image_id = s.image_id AND t.colour = s.colour AND t.a = s.other),
named AS (SELECT image_id, colour, label, min(other) AS region FROM spread GROUP BY ALL),
reg AS (SELECT r.image_id, r.colour, n.region, min(x1) AS x, min(y) AS y, max(x2) - min(x1) + 1 AS w, max(y) - min(y) + 1 AS h, sum(r.n)::BIGINT AS n FROM runs r JOIN named n USING (image_id, colour, label) GROUP BY ALL)"""


def pixels(spark, d):
    """The pixels of all images. Boxes are dealt by image before they are painted, so that neither pixels nor their runs are shuffled."""
    t = derived.truth(spark, d).select("image_id", "class_id", "x", "y", "w", "h")
    at = derived.dealt(t).selectExpr("*", "explode(sequence(0, h div 10 - 1)) as dy").selectExpr("*", "explode(sequence(0, w div 10 - 1)) as dx")
    p = at.groupBy("image_id", F.expr("cast(y div 10 + dy as int)").alias("y"), F.expr("cast(x div 10 + dx as int)").alias("x")).agg(F.max("class_id").alias("c"))
    return p.selectExpr(
        "image_id", "y", "x", "case c when 0 then 200 when 1 then 160 when 3 then 60 when 6 then 210 when 7 then 235 else 20 end as b",
        "case c when 0 then 90 when 1 then 30 when 3 then 150 when 4 then 210 when 5 then 205 when 6 then 100 when 7 then 220 else 25 end as g",
        "case c when 0 then 10 when 1 then 140 when 2 then 220 when 3 then 10 when 4 then 240 when 5 then 235 when 6 then 15 else 140 end as r",
    )


def coloured(spark, d):
    return ops.coloured(ops.hsv(pixels(spark, d)), facts.colours(spark))


def found(spark, d):
    return ops.regions(coloured(spark, d).filter("colour <> 'black'"))


@query("pixel_rows", f"WITH {PIX} SELECT * FROM pix")
def pixel_rows(spark, d):
    return pixels(spark, d)


@query("pixel_hsv", f"WITH {PIX} SELECT * FROM hsv")
def pixel_hsv(spark, d):
    return ops.hsv(pixels(spark, d)).select("image_id", "y", "x", "h", "s", "v")


@query("pixel_color", f"WITH {PIX} SELECT * FROM col")
def pixel_color(spark, d):
    return coloured(spark, d)


@query("color_histogram", f"WITH {PIX} SELECT image_id, colour, count(*) AS n FROM col GROUP BY ALL")
def color_histogram(spark, d):
    return coloured(spark, d).groupBy("image_id", "colour").agg(F.count("*").alias("n"))


@query("color_regions", f"WITH RECURSIVE {REG} SELECT * FROM reg")
def color_regions(spark, d):
    return found(spark, d)


@query("largest_region", f"WITH RECURSIVE {REG} SELECT image_id, colour, region, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, colour, region) AS k FROM reg) WHERE k = 1")
def largest_region(spark, d):
    return detections.first_by(found(spark, d), ["image_id"], [F.desc("n"), "colour", "region"]).select("image_id", "colour", "region", "n")


@query("region_filter", f"WITH RECURSIVE {REG} SELECT image_id, colour, region FROM reg WHERE abs(log2(w / h::DOUBLE)) <= 0.25 AND 1e6 * n / 2560 >= 1000 AND 1000.0::DOUBLE * n / (w * h) >= 500")
def region_filter(spark, d):
    return ops.shaped(found(spark, d), 2560.0).select("image_id", "colour", "region")


@query("region_fill", f"WITH RECURSIVE {REG} SELECT image_id, colour, region, n / (w * h)::DOUBLE AS fill FROM reg")
def region_fill(spark, d):
    return found(spark, d).select("image_id", "colour", "region", (F.col("n") / (F.col("w") * F.col("h")).cast("double")).alias("fill"))


@query("region_symbol", f"WITH RECURSIVE {REG}, f AS (SELECT *, n / (w * h)::DOUBLE AS fill FROM reg) SELECT image_id, colour, region, CASE WHEN colour = 'red' THEN 'Fuc' WHEN colour = 'purple' THEN 'NeuAc' WHEN colour = 'green' THEN 'Man' WHEN colour = 'blue' AND fill >= 0.8 THEN 'GlcNAc' WHEN colour = 'blue' AND fill > 0.5 THEN 'Glc' WHEN colour = 'yellow' AND fill > 0.9 THEN 'GalNAc' WHEN colour = 'yellow' AND fill > 0.5 THEN 'Gal' END AS symbol FROM f")
def region_symbol(spark, d):
    r = found(spark, d).withColumn("fill", F.col("n") / (F.col("w") * F.col("h")).cast("double"))
    return r.select("image_id", "colour", "region", ops.symbol_of(F.col("colour"), F.col("fill")).alias("symbol"))


@query("palette_jitter", f"WITH {TRUTH}, {facts.SQL_COLOURS} SELECT image_id, colour, CASE WHEN colour = 'black' THEN 0 ELSE h_lo + (image_id * 7919 + h_lo) % (h_hi - h_lo) END AS h, CASE WHEN colour = 'black' THEN 0 ELSE s_lo + (image_id * 104729 + s_lo) % (s_hi - s_lo) END AS s, CASE WHEN colour = 'black' THEN 0 ELSE v_lo + (image_id * 1299709 + v_lo) % (v_hi - v_lo) END AS v FROM (SELECT DISTINCT image_id FROM truth), colours")
def palette_jitter(spark, d):
    rows = derived.truth(spark, d).select("image_id").distinct().crossJoin(facts.colours(spark))  # seven colour ranges
    draw = lambda a, k: f"case when colour = 'black' then 0 else {a}_lo + (image_id * {k} + {a}_lo) % ({a}_hi - {a}_lo) end as {a}"
    return rows.selectExpr("image_id", "colour", draw("h", 7919), draw("s", 104729), draw("v", 1299709))


def area_sql(pixels: str) -> str:
    """Regions of (image_id, colour, y, x) rows with their areas, border pixels found one by one."""
    return PIX + f""", lab AS ({pixels}),
edge AS (SELECT p.*, NOT (EXISTS (SELECT 1 FROM lab q WHERE q.image_id = p.image_id AND q.colour = p.colour AND q.y = p.y AND q.x = p.x - 1) AND EXISTS (SELECT 1 FROM lab q WHERE q.image_id = p.image_id AND q.colour = p.colour AND q.y = p.y AND q.x = p.x + 1)
  AND EXISTS (SELECT 1 FROM lab q WHERE q.image_id = p.image_id AND q.colour = p.colour AND q.y = p.y - 1 AND q.x = p.x) AND EXISTS (SELECT 1 FROM lab q WHERE q.image_id = p.image_id AND q.colour = p.colour AND q.y = p.y + 1 AND q.x = p.x)) AS border FROM lab p),
runs0 AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, colour, y ORDER BY x) AS gap FROM edge),
runs AS (SELECT image_id, colour, y, min(x) AS x1, max(x) AS x2, count(*) AS n, count(*) FILTER (border) AS borders, y::BIGINT * 100000 + min(x) AS label FROM runs0 GROUP BY image_id, colour, y, gap),
touch AS (SELECT a.image_id, a.colour, a.label AS a, b.label AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.colour = b.colour AND abs(a.y - b.y) = 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1),
spread AS (SELECT image_id, colour, label, label AS other FROM runs UNION SELECT s.image_id, s.colour, s.label, t.b FROM spread s JOIN touch t ON t.image_id = s.image_id AND t.colour = s.colour AND t.a = s.other),
named AS (SELECT image_id, colour, label, min(other) AS region FROM spread GROUP BY ALL),
area AS (SELECT r.image_id, r.colour, n.region, min(x1) AS x, min(y) AS y, max(x2) - min(x1) + 1 AS w, max(y) - min(y) + 1 AS h, sum(r.n)::BIGINT AS n, sum(r.n) - sum(borders) / 2::DOUBLE - 1 AS area FROM runs r JOIN named n USING (image_id, colour, label) GROUP BY ALL)"""


COLOURED = "SELECT image_id, colour, y, x FROM col WHERE colour <> 'black'"
DARK = "SELECT image_id, 'dark' AS colour, y, x FROM pix WHERE floor((r * 299 + g * 587 + b * 114 + 500) / 1000) <= 230"


def with_areas(spark, d):
    return ops.areas(coloured(spark, d).filter("colour <> 'black'"))


@query("region_area", f"WITH RECURSIVE {area_sql(COLOURED)} SELECT image_id, colour, region // 100000 AS begin_y, region % 100000 AS begin_x, w, h, n, area FROM area")
def region_area(spark, d):
    return with_areas(spark, d).select("image_id", "colour", F.col("begin.y").alias("begin_y"), F.col("begin.x1").alias("begin_x"), "w", "h", "n", "area")


@query("region_filter_area", f"WITH RECURSIVE {area_sql(COLOURED)} SELECT image_id, colour, x, y, w, h FROM area WHERE abs(log2(w / h::DOUBLE)) <= 0.25 AND 1e6 * area / 2560 >= 1000 AND 1000.0::DOUBLE * area / (w * h) >= 500")
def region_filter_area(spark, d):
    return ops.shaped(with_areas(spark, d), 2560.0, size="area").select("image_id", "colour", "x", "y", "w", "h")


@query("largest_dark_region", f"WITH RECURSIVE {area_sql(DARK)} SELECT image_id, x, y, w, h, n, area FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, region DESC) AS k FROM area) WHERE k = 1")
def largest_dark_region(spark, d):
    return ops.largest_dark(pixels(spark, d)).select("image_id", "x", "y", "w", "h", "n", "area")
