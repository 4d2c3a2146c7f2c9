"""Queries that join detections to truth boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import overlap as ops
from sugarmill.plans.base import DET, query
from sugarmill.sources import derived

PAIRS = DET + """,
p0 AS (SELECT t.image_id, t.box_id AS t_box_id, t.class_id AS t_class_id, d.det_id AS d_det_id, d.class_id AS d_class_id, d.conf AS d_conf,
  (least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x) + 1) * (least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y) + 1) AS inter, (t.w + 1) * (t.h + 1) AS t_area, (d.w + 1) * (d.h + 1) AS d_area
  FROM truth t JOIN det d ON t.image_id = d.image_id AND t.x <= d.x + d.w AND d.x <= t.x + t.w AND t.y <= d.y + d.h AND d.y <= t.y + t.h),
pairs AS (SELECT *, inter / (t_area + d_area - inter)::DOUBLE AS iou FROM p0)"""
VERDICT = "iou > CASE WHEN inter = t_area THEN {c}::DOUBLE WHEN inter = d_area THEN {s}::DOUBLE ELSE {o}::DOUBLE END"
CURVE = VERDICT.format(c=0.95, s=0.75, o=0.3)
CANDS = PAIRS + f""",
good AS (SELECT * FROM pairs WHERE t_class_id = d_class_id AND {CURVE}),
rec AS (SELECT *, max(d_conf) OVER (PARTITION BY t_box_id ORDER BY iou DESC, d_conf DESC, d_det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good),
cands AS (SELECT * EXCLUDE (before), row_number() OVER (PARTITION BY t_box_id ORDER BY iou DESC, d_conf DESC, d_det_id) AS rank FROM rec WHERE d_conf > coalesce(before, 0))"""
PROFILES = "profiles(profile, containment, sufficiency, overlap) AS (VALUES " + ", ".join(f"('{k}', {c}::DOUBLE, {s}::DOUBLE, {o}::DOUBLE)" for k, (c, s, o) in ops.PROFILES.items()) + ")"


def assigned_sql(cands: str, by: str) -> str:
    """Recursive greedy matching over ``cands`` in groups of ``by``; defines ``edges``, ``walk`` and ``assigned``."""
    both = " AND ".join(f"e.{c} = w.{c}" for c in by.split(", "))
    cols = ", ".join(f"e.{c}" for c in by.split(", "))
    return f"""edges AS (SELECT {by}, t_box_id, d_det_id, row_number() OVER (PARTITION BY {by} ORDER BY iou DESC, d_conf DESC, t_box_id, d_det_id) AS rk FROM {cands}),
walk AS (SELECT {by}, 0::BIGINT AS rk, []::BIGINT[] AS ts, []::BIGINT[] AS ds, FALSE AS took, NULL::BIGINT AS box_id, NULL::BIGINT AS det_id FROM edges WHERE rk = 1
UNION ALL
SELECT {cols}, e.rk, CASE WHEN list_contains(w.ts, e.t_box_id) OR list_contains(w.ds, e.d_det_id) THEN w.ts ELSE list_append(w.ts, e.t_box_id) END,
  CASE WHEN list_contains(w.ts, e.t_box_id) OR list_contains(w.ds, e.d_det_id) THEN w.ds ELSE list_append(w.ds, e.d_det_id) END,
  NOT (list_contains(w.ts, e.t_box_id) OR list_contains(w.ds, e.d_det_id)), e.t_box_id, e.d_det_id
FROM walk w JOIN edges e ON {both} AND e.rk = w.rk + 1),
assigned AS (SELECT {by}, box_id, det_id FROM walk WHERE took)"""


def pairs(spark, d):
    return ops.paired(derived.truth(spark, d), derived.detections(spark, d))


def cands(spark, d):
    return ops.candidates(pairs(spark, d), ops.PROFILES["curve"])


@query("join_intersects", f"WITH {PAIRS} SELECT t_box_id AS box_id, d_det_id AS det_id FROM pairs")
def join_intersects(spark, d):
    return pairs(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"))


@query("join_intersection_area", f"WITH {PAIRS} SELECT t_box_id AS box_id, d_det_id AS det_id, inter FROM pairs")
def join_intersection_area(spark, d):
    return pairs(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"), "inter")


@query("join_iou", f"WITH {PAIRS} SELECT t_box_id AS box_id, d_det_id AS det_id, t_area + d_area - inter AS union_area, iou FROM pairs")
def join_iou(spark, d):
    return pairs(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"), (F.col("t_area") + F.col("d_area") - F.col("inter")).alias("union_area"), "iou")


@query("join_verdict", f"WITH {PAIRS} SELECT t_box_id AS box_id, d_det_id AS det_id, {CURVE} AS counts FROM pairs")
def join_verdict(spark, d):
    return pairs(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"), ops.verdict(*(F.lit(x) for x in ops.PROFILES["curve"])).alias("counts"))


@query("verdict_by_profile", f"WITH {PAIRS}, {PROFILES} SELECT profile, count(*) AS pairs, count(*) FILTER ({VERDICT.format(c='(containment)', s='(sufficiency)', o='(overlap)')}) AS good FROM pairs, profiles GROUP BY profile")
def verdict_by_profile(spark, d):
    rows = pairs(spark, d).crossJoin(ops.profiles(spark))  # six profiles
    return rows.groupBy("profile").agg(F.count("*").alias("pairs"), F.count_if(ops.verdict(F.col("containment"), F.col("sufficiency"), F.col("overlap"))).alias("good"))


@query("class_agreement", f"WITH {PAIRS} SELECT t_class_id = d_class_id AS agrees, count(*) AS pairs, sum(inter)::BIGINT AS inter FROM pairs GROUP BY 1")
def class_agreement(spark, d):
    return pairs(spark, d).groupBy((F.col("t_class_id") == F.col("d_class_id")).alias("agrees")).agg(F.count("*").alias("pairs"), F.sum("inter").cast("long").alias("inter"))


@query("match_candidates", f"WITH {CANDS} SELECT t_box_id AS box_id, d_det_id AS det_id, rank, iou, d_conf AS conf FROM cands")
def match_candidates(spark, d):
    return cands(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"), "rank", "iou", F.col("d_conf").alias("conf"))


@query("match_assignment", f"WITH RECURSIVE {CANDS}, cut AS (SELECT * FROM cands WHERE d_conf >= 0.3), {assigned_sql('cut', 'image_id')} SELECT * FROM assigned")
def match_assignment(spark, d):
    return ops.assigned(cands(spark, d).filter("d_conf >= 0.3"), ["image_id"])


NEAR = PAIRS + """,
near AS (SELECT d.det_id, d.image_id, d.class_id AS d_class_id, d.conf AS d_conf, p.t_box_id, p.t_class_id, p.inter, p.t_area, p.d_area, p.iou,
  row_number() OVER (PARTITION BY d.det_id ORDER BY p.inter DESC NULLS LAST, p.t_box_id) AS n FROM det d LEFT JOIN pairs p ON d.det_id = p.d_det_id)"""


@query("nearest_truth", f"WITH {NEAR} SELECT det_id, t_box_id AS box_id, inter FROM near WHERE n = 1")
def nearest_truth(spark, d):
    return ops.nearest_truth(derived.truth(spark, d), derived.detections(spark, d)).select(F.col("d_det_id").alias("det_id"), F.col("t_box_id").alias("box_id"), "inter")


@query("undetected_truth", f"WITH {PAIRS} SELECT box_id, image_id, class_id FROM truth WHERE box_id NOT IN (SELECT t_box_id FROM pairs)")
def undetected_truth(spark, d):
    return ops.undetected(derived.truth(spark, d), derived.detections(spark, d)).select("box_id", "image_id", "class_id")


@query("pair_verdict", f"""WITH {PAIRS} SELECT t_box_id AS box_id, d_det_id AS det_id, CASE WHEN d_conf < 0.3 THEN 'below confidence' WHEN t_class_id <> d_class_id THEN 'incorrect class'
  WHEN inter = t_area AND iou <= 0.95::DOUBLE THEN 'area too large' WHEN inter <> t_area AND inter = d_area AND iou <= 0.75::DOUBLE THEN 'area too small'
  WHEN inter <> t_area AND inter <> d_area AND iou <= 0.3::DOUBLE THEN 'not enough overlap' ELSE 'TP' END AS reason FROM pairs""")
def pair_verdict(spark, d):
    return pairs(spark, d).select(F.col("t_box_id").alias("box_id"), F.col("d_det_id").alias("det_id"), ops.pair_reason(ops.PROFILES["curve"], 0.3).alias("reason"))


def side(*args):
    px, py, qx, qy, ax, ay, bx, by = (f"({a})" for a in args)
    det = f"(({qx} - {px}) * ({by} - {ay}) - ({qy} - {py}) * ({bx} - {ax}))"
    t = f"((({ax} - {px}) * ({by} - {ay}) - ({ay} - {py}) * ({bx} - {ax}))::DOUBLE / nullif({det}, 0))"
    u = f"((({ax} - {px}) * ({qy} - {py}) - ({ay} - {py}) * ({qx} - {px}))::DOUBLE / nullif({det}, 0))"
    return f"coalesce({t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1, FALSE)"


SIDES = " OR ".join(side("s.px", "s.py", "s.qx", "s.qy", *r) for r in (("t.x", "t.y", "t.x + t.w", "t.y"), ("t.x", "t.y + t.h", "t.x + t.w", "t.y + t.h"), ("t.x", "t.y", "t.x", "t.y + t.h"), ("t.x + t.w", "t.y", "t.x + t.w", "t.y + t.h")))


@query("join_segment_rect", f"WITH {DET}, s AS (SELECT image_id, box_id AS segment_id, x AS px, y AS py, CAST(x - 100 + (box_id * 71) % 300 AS INT) AS qx, CAST(y - 100 + (box_id * 73) % 300 AS INT) AS qy FROM truth WHERE box_id % 3 = 0) SELECT s.segment_id, t.box_id FROM s JOIN truth t ON s.image_id = t.image_id AND ({SIDES})")
def join_segment_rect(spark, d):
    t = derived.truth(spark, d)
    s = t.filter("box_id % 3 = 0").selectExpr("image_id as si", "box_id as segment_id", "x as px", "y as py", "cast(x - 100 + (box_id * 71) % 300 as int) as qx", "cast(y - 100 + (box_id * 73) % 300 as int) as qy")
    hit = ops.segment_hits_rectangle(*(F.col(c) for c in ("px", "py", "qx", "qy", "x", "y", "w", "h")))
    return s.join(t, (F.col("si") == F.col("image_id")) & hit).select("segment_id", "box_id")
