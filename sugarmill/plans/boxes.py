"""Queries over box geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import boxes as ops
from sugarmill.plans.base import DET, TRUTH, query
from sugarmill.sources import derived

CEN = "CAST(trunc(x + w / 2.0::DOUBLE) AS INT)"
CENY = "CAST(trunc(y + h / 2.0::DOUBLE) AS INT)"
T = f"WITH {TRUTH} "
C = f"WITH {TRUTH}, cen AS (SELECT *, {CEN} AS cen_x, {CENY} AS cen_y FROM truth) "
REL = f"WITH {TRUTH}, rel AS (SELECT box_id, imwidth, imheight, (box_id * 37 % 1000)::DOUBLE / 1000 AS rel_cen_x, (box_id * 41 % 1000)::DOUBLE / 1000 AS rel_cen_y, (box_id * 43 % 500)::DOUBLE / 1000 AS rel_w, (box_id * 47 % 500)::DOUBLE / 1000 AS rel_h FROM truth) "
#: Boxes that stick out of the image on all sides.
OUT = f"WITH {TRUTH}, wild AS (SELECT box_id, CAST(x - 60 + (box_id * 61) % 130 AS INT) AS x, CAST(y - 60 + (box_id * 67) % 170 AS INT) AS y, CAST(w * (1 + box_id % 9) AS INT) AS w, CAST(h * (1 + box_id % 6) AS INT) AS h, imwidth, imheight FROM truth) "


def relative(spark, d):
    r = [f"cast(box_id * {m} % {n} as double) / 1000 as {c}" for c, m, n in (("rel_cen_x", 37, 1000), ("rel_cen_y", 41, 1000), ("rel_w", 43, 500), ("rel_h", 47, 500))]
    return derived.truth(spark, d).selectExpr("box_id", "imwidth", "imheight", *r)


def wild(spark, d):
    return derived.truth(spark, d).selectExpr("box_id", "cast(x - 60 + (box_id * 61) % 130 as int) as x", "cast(y - 60 + (box_id * 67) % 170 as int) as y", "cast(w * (1 + box_id % 9) as int) as w", "cast(h * (1 + box_id % 6) as int) as h", "imwidth", "imheight")


@query("box_abs_to_rel", C + "SELECT box_id, cen_x / imwidth::DOUBLE AS rel_cen_x, cen_y / imheight::DOUBLE AS rel_cen_y, w / imwidth::DOUBLE AS rel_w, h / imheight::DOUBLE AS rel_h FROM cen")
def box_abs_to_rel(spark, d):
    return ops.to_relative(ops.centres(derived.truth(spark, d))).select("box_id", "rel_cen_x", "rel_cen_y", "rel_w", "rel_h")


@query("box_rel_to_abs", REL + "SELECT box_id, CAST(trunc(rel_cen_x * 840) AS INT) AS cen_x, CAST(trunc(rel_cen_y * 600) AS INT) AS cen_y, CAST(trunc(rel_w * 840) AS INT) AS w, CAST(trunc(rel_h * 600) AS INT) AS h FROM rel")
def box_rel_to_abs(spark, d):
    return ops.to_absolute(relative(spark, d), 200).select("box_id", "cen_x", "cen_y", "w", "h")


@query("box_corners", C + "SELECT box_id, cen_x, cen_y, CAST(trunc(cen_x - w / 2.0::DOUBLE) AS INT) AS x, CAST(trunc(cen_y - h / 2.0::DOUBLE) AS INT) AS y FROM cen")
def box_corners(spark, d):
    return ops.corners(ops.centres(derived.truth(spark, d))).select("box_id", "cen_x", "cen_y", "x", "y")


@query("box_four_corners", T + "SELECT box_id, CASE WHEN w - 45 <= 0 THEN 1 ELSE w - 45 END AS w, CASE WHEN h - 45 <= 0 THEN 1 ELSE h - 45 END AS h, x + CASE WHEN w - 45 <= 0 THEN 1 ELSE w - 45 END AS x2, y + CASE WHEN h - 45 <= 0 THEN 1 ELSE h - 45 END AS y2 FROM truth")
def box_four_corners(spark, d):
    t = derived.truth(spark, d).withColumns({"w": F.col("w") - 45, "h": F.col("h") - 45})
    return ops.four_corners(t).select("box_id", "w", "h", "x2", "y2")


@query("box_unpad", C + "SELECT box_id, cen_x - 100 AS cen_x, cen_y - 100 AS cen_y, (cen_x - 100) / imwidth::DOUBLE AS rel_cen_x, (cen_y - 100) / imheight::DOUBLE AS rel_cen_y, w / imwidth::DOUBLE AS rel_w, h / imheight::DOUBLE AS rel_h FROM cen")
def box_unpad(spark, d):
    return ops.unpad(ops.centres(derived.truth(spark, d)), 200).select("box_id", "cen_x", "cen_y", "rel_cen_x", "rel_cen_y", "rel_w", "rel_h")


@query("box_clip", OUT + ", c AS (SELECT *, greatest(x, 0) AS cx, greatest(y, 0) AS cy FROM wild) SELECT box_id, cx AS x, cy AS y, CASE WHEN cx + w >= imwidth THEN imwidth - cx ELSE w END AS w, CASE WHEN cy + h >= imheight THEN imheight - cy ELSE h END AS h FROM c")
def box_clip(spark, d):
    return ops.clip(wild(spark, d)).select("box_id", "x", "y", "w", "h")


@query("box_pad", T + "SELECT box_id, x - CAST(trunc(0.2::DOUBLE * w) AS INT) AS x, y - CAST(trunc(0.2::DOUBLE * h) AS INT) AS y, CAST(trunc(1.4::DOUBLE * w) AS INT) AS w, CAST(trunc(1.4::DOUBLE * h) AS INT) AS h, 20 AS percent FROM truth UNION ALL SELECT box_id, x - CAST(trunc(0.1::DOUBLE * w) AS INT), y - CAST(trunc(0.1::DOUBLE * h) AS INT), CAST(trunc(1.2::DOUBLE * w) AS INT), CAST(trunc(1.2::DOUBLE * h) AS INT), 10 FROM truth")
def box_pad(spark, d):
    t = derived.truth(spark, d)
    one = lambda share, n: ops.pad(t, share).select("box_id", "x", "y", "w", "h", F.lit(n).alias("percent"))
    return one(0.2, 20).unionByName(one(0.1, 10))


@query("box_snap_full", OUT + ", f AS (SELECT *, w * h > 0.64::DOUBLE * imwidth * imheight AS big FROM wild) SELECT box_id, CASE WHEN big THEN 0 ELSE x END AS x, CASE WHEN big THEN 0 ELSE y END AS y, CASE WHEN big THEN imwidth ELSE w END AS w, CASE WHEN big THEN imheight ELSE h END AS h FROM f")
def box_snap_full(spark, d):
    return ops.snap_full(wild(spark, d)).select("box_id", "x", "y", "w", "h")


@query("box_full_truth", T + "SELECT box_id, 0.5::DOUBLE AS rel_cen_x, 0.5::DOUBLE AS rel_cen_y, 1.0::DOUBLE AS rel_w, 1.0::DOUBLE AS rel_h FROM truth")
def box_full_truth(spark, d):
    return ops.full_truth(derived.truth(spark, d)).select("box_id", "rel_cen_x", "rel_cen_y", "rel_w", "rel_h")


@query("box_pad_image", C + "SELECT box_id, cen_x + 100 AS cen_x, cen_y + 100 AS cen_y, imwidth + 200 AS imwidth, imheight + 200 AS imheight FROM cen")
def box_pad_image(spark, d):
    return ops.pad_image(ops.centres(derived.truth(spark, d)), 200).select("box_id", "cen_x", "cen_y", "imwidth", "imheight")


@query("box_pdf_coords", T + "SELECT box_id, x / imwidth::DOUBLE AS px0, y / imheight::DOUBLE AS py0, (x + w) / imwidth::DOUBLE AS px1, (y + h) / imheight::DOUBLE AS py1 FROM truth")
def box_pdf_coords(spark, d):
    return ops.page_corners(ops.four_corners(derived.truth(spark, d))).select("box_id", "px0", "py0", "px1", "py1")


@query("box_area", T + "SELECT box_id, (w + 1) * (h + 1) AS area FROM truth")
def box_area(spark, d):
    return derived.truth(spark, d).select("box_id", ops.area(F.col("w"), F.col("h")).alias("area"))


@query("box_training_rows", C + "SELECT box_id, concat_ws(' ', class_id, printf('%.8f', cen_x / imwidth::DOUBLE), printf('%.8f', cen_y / imheight::DOUBLE), printf('%.8f', w / imwidth::DOUBLE), printf('%.8f', h / imheight::DOUBLE)) AS training_row, concat_ws(' ', class_id, x, y, w, h) AS detected_row FROM cen")
def box_training_rows(spark, d):
    t = ops.to_relative(ops.centres(derived.truth(spark, d)))
    shares = [F.format_string("%.8f", c) for c in ("rel_cen_x", "rel_cen_y", "rel_w", "rel_h")]
    return t.select("box_id", F.concat_ws(" ", F.col("class_id").cast("string"), *shares).alias("training_row"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("class_id", "x", "y", "w", "h"))).alias("detected_row"))


@query("box_text", f"WITH {DET} SELECT det_id, printf('class %d at (%d, %d) size %d x %d confidence %.4f', class_id, x, y, w, h, conf) AS text FROM det")
def box_text(spark, d):
    return derived.detections(spark, d).select("det_id", F.format_string("class %d at (%d, %d) size %d x %d confidence %.4f", "class_id", "x", "y", "w", "h", "conf").alias("text"))


@query("box_magnify", T + ", m AS (SELECT *, greatest(1.0::DOUBLE, 84000.0::DOUBLE / ((imheight - (box_id % 3) * 180) * (imwidth - (box_id % 3) * 180))) AS mag FROM truth) SELECT box_id, mag, CAST(trunc((x + 30) * mag) AS INT) AS x, CAST(trunc((y + 30) * mag) AS INT) AS y, CAST(trunc(w * mag) AS INT) AS w, CAST(trunc(h * mag) AS INT) AS h FROM m")
def box_magnify(spark, d):
    less = (F.col("box_id") % 3) * 180
    t = derived.truth(spark, d).withColumns({"imheight": F.col("imheight") - less, "imwidth": F.col("imwidth") - less})
    return ops.magnified(t).select("box_id", "mag", "x", "y", "w", "h")
