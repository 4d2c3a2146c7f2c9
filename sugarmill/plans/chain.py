"""Queries that run the whole chain: symbols by box or contour, links, root by one of three methods, tree, text, lookup."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.operators import chain as ops
from sugarmill.operators import detections, textforms
from sugarmill.operators import pixels as pixel_ops
from sugarmill.operators.annotation import PIPELINES
from sugarmill.plans import annotation, pixels, trees
from sugarmill.plans import overlap as joins
from sugarmill.plans.base import SYMBOL, query
from sugarmill.plans.detections import NMS
from sugarmill.sources import derived, facts

SYMBOL_OF = "CASE WHEN colour = 'red' THEN 'Fuc' WHEN colour = 'purple' THEN 'NeuAc' WHEN colour = 'green' THEN 'Man' WHEN colour = 'blue' AND fill >= 0.8 THEN 'GlcNAc' WHEN colour = 'blue' AND fill > 0.5 THEN 'Glc' WHEN colour = 'yellow' AND fill > 0.9 THEN 'GalNAc' WHEN colour = 'yellow' AND fill > 0.5 THEN 'Gal' END"
#: Levels of subtree texts that the SQL writes out; an image holds fewer symbols.
LEVELS = 20
#: Image and source as one number, and that with the root method as another.
FOUND = f"""boxed AS (WITH RECURSIVE {NMS[len("WITH RECURSIVE "):NMS.index("SELECT image_id, k.det_id")]} SELECT out.image_id, 0 AS s, det.det_id AS place, symbol, det.x, det.y, det.w, det.h FROM out JOIN det ON det.image_id = out.image_id AND det.det_id = out.k.det_id JOIN dim_symbol USING (class_id)),
seen AS (WITH RECURSIVE {pixels.REG}, f AS (SELECT *, n / (w * h)::DOUBLE AS fill FROM reg), meant AS (SELECT *, {SYMBOL_OF} AS symbol FROM f) SELECT image_id, 1 AS s, row_number() OVER (PARTITION BY image_id ORDER BY y // 10, x, colour, region) AS place, symbol, x * 10 AS x, y * 10 AS y, w * 10 AS w, h * 10 AS h FROM meant WHERE symbol IS NOT NULL),
monos AS (SELECT image_id * 2 + s AS image_id, row_number() OVER (PARTITION BY image_id, s ORDER BY place) - 1 AS mono_idx, symbol, x, y, w, h, 640 AS imwidth, 400 AS imheight,
  CAST(trunc(x + w / 2.0::DOUBLE) AS INT) AS cen_x, CAST(trunc(y + h / 2.0::DOUBLE) AS INT) AS cen_y FROM (SELECT * FROM boxed UNION ALL SELECT * FROM seen))"""
ROOTS = f"""vote AS (SELECT l.image_id, CASE WHEN count(*) FILTER (abs(p.cen_x - q.cen_x) > abs(p.cen_y - q.cen_y)) >= count(*) FILTER (abs(p.cen_y - q.cen_y) > abs(p.cen_x - q.cen_x)) THEN 1 ELSE 3 END AS orientation FROM links l JOIN monos p ON p.image_id = l.image_id AND p.mono_idx = l.a JOIN monos q ON q.image_id = l.image_id AND q.mono_idx = l.b GROUP BY 1),
best AS (SELECT image_id, class_id % 4 AS orientation FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS n FROM det) WHERE n = 1),
turned AS (SELECT m.*, 0 AS way, v.orientation FROM monos m LEFT JOIN vote v ON v.image_id = m.image_id UNION ALL SELECT m.*, 1 AS way, b.orientation FROM monos m LEFT JOIN best b ON b.image_id = m.image_id // 2),
led AS (SELECT image_id, way, mono_idx, row_number() OVER (PARTITION BY image_id, way ORDER BY CASE orientation WHEN 0 THEN cen_x WHEN 1 THEN -cen_x WHEN 2 THEN cen_y WHEN 3 THEN -cen_y ELSE 0 END, mono_idx) AS n FROM turned WHERE symbol <> 'Fuc'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS n FROM det WHERE class_id = 0) WHERE n = 1),
over0 AS (SELECT t.image_id, t.mono_idx, (least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x) + 1) * (least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y) + 1) AS inter, (t.w + 1) * (t.h + 1) AS t_area, (d.w + 1) * (d.h + 1) AS d_area
  FROM monos t JOIN top d ON t.image_id // 2 = d.image_id AND t.x <= d.x + d.w AND d.x <= t.x + t.w AND t.y <= d.y + d.h AND d.y <= t.y + t.h),
over1 AS (SELECT *, inter / (t_area + d_area - inter)::DOUBLE AS iou, row_number() OVER (PARTITION BY image_id ORDER BY inter DESC, mono_idx) AS n FROM over0),
roots AS (SELECT image_id * 3 + way AS gid, mono_idx AS node FROM led WHERE n = 1 UNION ALL SELECT image_id * 3 + 2, mono_idx FROM over1 WHERE n = 1 AND {joins.VERDICT.format(c=0.5, s=0.5, o=0.5)})"""
TREES = f"""ways(way) AS (VALUES (0), (1), (2)), lines AS (SELECT image_id * 3 + way AS gid, a, b FROM links, ways), both_ways AS (SELECT gid, a, b FROM lines UNION ALL SELECT gid, b, a FROM lines),
reach AS (SELECT gid, node FROM roots UNION SELECT r.gid, b.b FROM reach r JOIN both_ways b ON b.gid = r.gid AND b.a = r.node),
size AS (SELECT image_id * 3 + way AS gid, count(*) AS n FROM monos, ways GROUP BY 1),
good AS (SELECT s.gid FROM size s JOIN (SELECT gid, count(*) AS e FROM lines GROUP BY 1) l USING (gid) JOIN (SELECT gid, count(*) AS r FROM reach GROUP BY 1) r USING (gid) WHERE s.n > 1 AND r.r = s.n AND l.e < s.n),
walk AS (SELECT r.gid, r.node, NULL::BIGINT AS parent, 0 AS depth FROM roots r JOIN good USING (gid) UNION ALL SELECT w.gid, b.b, b.a, w.depth + 1 FROM walk w JOIN both_ways b ON b.gid = w.gid AND b.a = w.node AND b.b IS DISTINCT FROM w.parent),
lab AS (SELECT w.*, m.symbol FROM walk w JOIN monos m ON m.image_id = w.gid // 3 AND m.mono_idx = w.node),
t{LEVELS} AS (SELECT NULL::BIGINT AS gid, NULL::BIGINT AS node, NULL::BIGINT AS parent, NULL::VARCHAR AS text WHERE FALSE)""" + "".join(
    f", t{k} AS (SELECT l.gid, l.node, l.parent, l.symbol || '(' || coalesce(c.kids, '') || ')' AS text FROM lab l LEFT JOIN (SELECT gid, parent, string_agg(text, ',' ORDER BY text) AS kids FROM t{k + 1} GROUP BY ALL) c ON c.gid = l.gid AND c.parent = l.node WHERE l.depth = {k})" for k in range(LEVELS - 1, -1, -1)
)
#: The drawn lines: from a symbol to the one before it in its row of four, or above it. What is seen of a line lies a fifth of the way along it.
CON = "con AS (SELECT a.image_id, a.mono_idx AS contour_idx, (4 * a.cen_x + b.cen_x) // 5 AS cx, (4 * a.cen_y + b.cen_y) // 5 AS cy FROM monos a JOIN monos b ON a.image_id = b.image_id AND b.mono_idx = CASE WHEN a.mono_idx % 4 = 0 THEN a.mono_idx - 4 ELSE a.mono_idx - 1 END)"
CHAIN = f"{joins.DET}, {SYMBOL}, {FOUND}{trees.LINKS[len(trees.MONOS):].replace(trees.CON, CON)}, {ROOTS}, {TREES}"
NAME = "CASE gid // 3 % 2 WHEN 0 THEN 'box' ELSE 'contour' END || CASE gid % 3 WHEN 0 THEN '-vote' WHEN 1 THEN '-orientation' ELSE '-root' END"


SIZE = ("640 as imwidth", "400 as imheight")


def by_box(spark, d):
    """The kept detections."""
    det = derived.detections(spark, d)
    kept = detections.non_max_suppression(det, 0.3, 0.4).join(det.select("image_id", "det_id", "class_id"), ["image_id", "det_id"]).join(derived.dim_symbol(spark), "class_id")
    return ops.numbered(kept.selectExpr("*", *SIZE), "box", "det_id")


def by_contour(spark, d):
    """The colour regions of the painted pixels, at full size."""
    r = pixels.found(spark, d).withColumn("fill", F.col("n") / (F.col("w") * F.col("h")).cast("double"))
    r = r.withColumn("symbol", pixel_ops.symbol_of(F.col("colour"), F.col("fill"))).filter("symbol is not null").withColumns({c: F.col(c) * 10 for c in "xywh"}).selectExpr("*", *SIZE)
    return ops.numbered(r, "contour", F.expr("y div 100"), "x", "colour", "region")


SOURCES = {"box": by_box, "contour": by_contour}


def contours(m):
    a = m.select("image_id", F.col("mono_idx").alias("contour_idx"), F.col("cen_x").alias("ax"), F.col("cen_y").alias("ay"), F.expr("case when mono_idx % 4 = 0 then mono_idx - 4 else mono_idx - 1 end as before"))
    b = m.select("image_id", F.col("mono_idx").alias("before"), F.col("cen_x").alias("bx"), F.col("cen_y").alias("by"))
    return a.join(b, ["image_id", "before"]).select("image_id", "contour_idx", F.expr("(4 * ax + bx) div 5").alias("cx"), F.expr("(4 * ay + by) div 5").alias("cy"))


def parts(spark, d, sources=("box", "contour")):
    s = ops.cut(functools.reduce(DataFrame.unionByName, [SOURCES[k](spark, d) for k in sources]))
    return s, contours(ops.keyed(s)), derived.detections(spark, d)


def registered(texts):
    """Accessions of a third of the structures as such, and of another third as equivalents."""
    t = texts.select("text", F.col("glycan_id.image_id").alias("image_id"))
    exact = t.filter("image_id % 3 = 0").select("text", F.concat(F.lit("G"), F.lpad(F.col("image_id").cast("string"), 7, "0")).alias("accession"))
    return exact, t.filter("image_id % 3 = 1").select("text", F.concat(F.lit("T"), F.col("image_id").cast("string")).alias("accession"))


def annotated_sql(only: str) -> str:
    """The rows of those pipelines whose number meets a condition."""
    return f"""WITH RECURSIVE {CHAIN},
cnt AS (SELECT image_id, symbol, count(*) AS n FROM monos GROUP BY ALL), cmp AS (SELECT image_id * 3 + way AS gid, sum(n)::BIGINT AS symbols, string_agg(symbol || '(' || n || ')', '' ORDER BY symbol) AS composition FROM cnt, ways GROUP BY 1),
texts AS (SELECT * FROM t0 WHERE {only}), e1 AS (SELECT text, min('G' || lpad((gid // 6)::VARCHAR, 7, '0')) AS a FROM texts WHERE gid // 6 % 3 = 0 GROUP BY 1), e2 AS (SELECT text, min('T' || gid // 6) AS a FROM texts WHERE gid // 6 % 3 = 1 GROUP BY 1),
final AS (SELECT c.gid // 6 AS image_id, {NAME.replace("gid", "c.gid")} AS pipeline, c.symbols, c.composition, t.text AS structure, coalesce(e1.a, e2.a) AS accession, CASE WHEN e1.a IS NOT NULL THEN 'exact' WHEN e2.a IS NOT NULL THEN 'equivalent' END AS source
  FROM (SELECT * FROM cmp WHERE {only}) c LEFT JOIN texts t ON t.gid = c.gid LEFT JOIN e1 ON e1.text = t.text LEFT JOIN e2 ON e2.text = t.text)
SELECT *, {annotation.URI} FROM final"""


@query("annotate_chain", annotated_sql("gid % 6 = 0"))
def annotate_chain(spark, d):
    """Every image by one pipeline: symbols from detections, the root by the vote of the links."""
    return annotated(spark, d, ["box-vote"])


@query("annotate_by_pipeline", annotated_sql("TRUE"))
def annotate_by_pipeline(spark, d):
    """Every image by all six pipelines."""
    return annotated(spark, d, list(PIPELINES))


def annotated(spark, d, pipelines: list[str]):
    """Images by the named pipelines; sources and methods that several share are worked out once."""
    unknown = [p for p in pipelines if p not in PIPELINES]
    if unknown:
        raise ValueError(f"no pipeline {unknown[0]!r}; there are {', '.join(PIPELINES)}")
    chosen = [PIPELINES[p] for p in pipelines]
    sources, methods = dict.fromkeys(s for s, _ in chosen), dict.fromkeys(m for _, m in chosen)
    return ops.annotate(*parts(spark, d, tuple(sources)), registered, tuple(methods)).filter(F.col("pipeline").isin(pipelines))


BODY = ", ".join(f"('{s[0]}', '{s[2]}-{s[1]}')" for s in facts.SYMBOL_KEYS)


@query("structure_text", f"""WITH RECURSIVE {CHAIN}, every AS ({" UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(LEVELS))}),
steps AS (SELECT gid, node, [{{'text': text, 'node': node}}] AS path FROM t0 UNION ALL SELECT e.gid, e.node, list_append(s.path, {{'text': e.text, 'node': e.node}}) FROM steps s JOIN every e ON e.gid = s.gid AND e.parent = s.node),
num AS (SELECT gid, node, row_number() OVER (PARTITION BY gid ORDER BY path) AS k FROM steps), bodies(symbol, body) AS (VALUES {BODY}),
res AS (SELECT n.gid, string_agg(n.k || 'b:x-' || b.body, chr(10) ORDER BY n.k) AS t FROM num n JOIN lab l USING (gid, node) JOIN bodies b USING (symbol) GROUP BY 1),
lin AS (SELECT n.gid, string_agg((n.k - 1) || ':' || p.k || 'o(-1+' || CASE WHEN l.symbol = 'NeuAc' THEN 2 ELSE 1 END || ')' || n.k || 'd', chr(10) ORDER BY n.k) AS t FROM num n JOIN lab l USING (gid, node) JOIN num p ON p.gid = n.gid AND p.node = l.parent GROUP BY 1)
SELECT gid // 6 AS image_id, {NAME} AS pipeline, 'RES' || chr(10) || res.t || chr(10) || 'LIN' || chr(10) || lin.t AS text FROM res JOIN lin USING (gid)""")
def structure_text(spark, d):
    """The built trees of all six pipelines in the residue and link notation."""
    n = ops.cut(ops.linked_residues(ops.trees(*parts(spark, d))).join(facts.small(spark, [(s[0], f"{s[2]}-{s[1]}") for s in facts.SYMBOL_KEYS], "symbol string, body string"), "symbol"))
    res = n.select("glycan_id", "residue", F.concat("residue", F.lit("b:x-"), "body").alias("line"))
    lin = n.filter("parent is not null").select("glycan_id", (F.col("residue") - 1).alias("link"), F.concat(F.col("residue") - 1, F.lit(":"), "parent_residue", F.lit("o(-1+"), "child_pos", F.lit(")"), "residue", F.lit("d")).alias("line"))
    text = textforms.structure_text(res, lin, "glycan_id")
    return text.select("glycan_id.image_id", ops.pipeline_name().alias("pipeline"), "text")
