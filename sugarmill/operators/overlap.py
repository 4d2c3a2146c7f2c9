"""Joining detections to truth boxes of the same image by overlap. Areas count both edge pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Threshold profiles: containment, sufficiency, overlap.
PROFILES = {"padded": (0.95, 0.95, 0.25), "raw": (0.95, 0.95, 0.5), "class": (0.5, 0.5, 0.5), "curve": (0.95, 0.75, 0.3), "symbols": (0.8, 0.75, 0.6), "root": (0.5, 0.5, 0.5)}


def paired(truth: DataFrame, det: DataFrame, how: str = "inner") -> DataFrame:
    """Intersecting (truth, detection) pairs, touching included, with inter, t_area, d_area and iou. Columns get t_ and d_."""
    t = truth.select(F.col("image_id"), *(F.col(c).alias(f"t_{c}") for c in ("box_id", "class_id", "x", "y", "w", "h")))
    d = det.select(F.col("image_id"), *(F.col(c).alias(f"d_{c}") for c in ("det_id", "class_id", "x", "y", "w", "h", "conf")))
    hit = (t.image_id == d.image_id) & (F.col("t_x") <= F.col("d_x") + F.col("d_w")) & (F.col("d_x") <= F.col("t_x") + F.col("t_w")) & (F.col("t_y") <= F.col("d_y") + F.col("d_h")) & (F.col("d_y") <= F.col("t_y") + F.col("t_h"))
    joined = d.join(t, hit, "left").drop(t.image_id) if how == "left" else t.join(d, hit).drop(d.image_id)
    wide = F.least(F.col("t_x") + F.col("t_w"), F.col("d_x") + F.col("d_w")) - F.greatest("t_x", "d_x") + 1
    high = F.least(F.col("t_y") + F.col("t_h"), F.col("d_y") + F.col("d_h")) - F.greatest("t_y", "d_y") + 1
    out = joined.withColumns({"inter": F.when(F.col("t_box_id").isNotNull(), wide * high), "t_area": (F.col("t_w") + 1) * (F.col("t_h") + 1), "d_area": (F.col("d_w") + 1) * (F.col("d_h") + 1)})
    return out.withColumn("iou", F.col("inter") / (F.col("t_area") + F.col("d_area") - F.col("inter")).cast("double"))


def verdict(containment, sufficiency, overlap) -> Column:
    """Whether a pair's geometry counts: a truth inside the detection, a detection inside the truth, or overlap."""
    limit = F.when(F.col("inter") == F.col("t_area"), containment).when(F.col("inter") == F.col("d_area"), sufficiency).otherwise(overlap)
    return F.col("iou") > limit


def profiles(spark) -> DataFrame:
    """The threshold profiles as a table of six rows."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "profile string, containment double, sufficiency double, overlap double"))


def candidates(pairs: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """Each truth's detections by falling overlap whose confidence exceeds all before; rank counts them from one."""
    good = pairs.filter((F.col("t_class_id") == F.col("d_class_id")) & verdict(*(F.lit(x) for x in limits)))
    order = Window.partitionBy("t_box_id").orderBy(F.desc("iou"), F.desc("d_conf"), "d_det_id")
    rows = good.withColumn("before", F.max("d_conf").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("d_conf") > F.coalesce("before", F.lit(0.0)))
    return rows.withColumn("rank", F.row_number().over(order)).drop("before")


def assigned(cands: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one pairs in each group of ``by``: pairs by falling overlap, each taken if both its boxes are free.

    Both sides prefer larger overlap, so this is the stable matching. An image has few boxes, so a group folds in one aggregate.
    """
    edge = F.struct((-F.col("iou")).alias("neg"), (-F.col("d_conf")).alias("neg_conf"), F.col("t_box_id").alias("t"), F.col("d_det_id").alias("d"))
    groups = cands.groupBy(*by).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    none = F.filter("edges", lambda e: F.lit(False))
    taken = F.aggregate("edges", none, lambda out, e: F.when(F.exists(out, lambda o: (o["t"] == e["t"]) | (o["d"] == e["d"])), out).otherwise(F.concat(out, F.array(e))))
    return groups.select(*by, F.explode(taken).alias("e")).select(*by, F.col("e.t").alias("box_id"), F.col("e.d").alias("det_id"))


def nearest_truth(truth: DataFrame, det: DataFrame) -> DataFrame:
    """For every detection the truth it overlaps most, the first of equals; null if it hits none."""
    order = Window.partitionBy("image_id", "d_det_id").orderBy(F.desc_nulls_last("inter"), "t_box_id")
    return paired(truth, det, "left").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def undetected(truth: DataFrame, det: DataFrame) -> DataFrame:
    """Truths that no detection touches."""
    d = det.select(F.col("image_id").alias("i"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("w").alias("dw"), F.col("h").alias("dh"))
    hit = (F.col("image_id") == F.col("i")) & (F.col("x") <= F.col("dx") + F.col("dw")) & (F.col("dx") <= F.col("x") + F.col("w")) & (F.col("y") <= F.col("dy") + F.col("dh")) & (F.col("dy") <= F.col("y") + F.col("h"))
    return truth.join(d, hit, "left_anti")


def pair_reason(limits: tuple[float, float, float], threshold: float) -> Column:
    """The first reason against a pair, or TP."""
    c, s, o = limits
    return (
        F.when(F.col("d_conf") < threshold, "below confidence")
        .when(F.col("t_class_id") != F.col("d_class_id"), "incorrect class")
        .when((F.col("inter") == F.col("t_area")) & (F.col("iou") <= c), "area too large")
        .when((F.col("inter") != F.col("t_area")) & (F.col("inter") == F.col("d_area")) & (F.col("iou") <= s), "area too small")
        .when((F.col("inter") != F.col("t_area")) & (F.col("inter") != F.col("d_area")) & (F.col("iou") <= o), "not enough overlap")
        .otherwise("TP")
    )


def segment_hits(px, py, qx, qy, ax, ay, bx, by) -> Column:
    """Whether segment p-q meets segment a-b; parallel ones do not."""
    det = (qx - px) * (by - ay) - (qy - py) * (bx - ax)
    t = ((ax - px) * (by - ay) - (ay - py) * (bx - ax)) / det
    u = ((ax - px) * (qy - py) - (ay - py) * (qx - px)) / det
    return F.coalesce((det != 0) & t.between(0, 1) & u.between(0, 1), F.lit(False))


def segment_hits_rectangle(px, py, qx, qy, x, y, w, h) -> Column:
    """Whether a segment meets any of a rectangle's four sides; parallel ones do not.

    In doubles, which hold these products of whole pixels exactly, and without dividing: longer code would not be compiled to machine code.
    """
    px, py, qx, qy, x, y, w, h = (c.cast("double") for c in (px, py, qx, qy, x, y, w, h))

    def side(pa, qa, pb, qb, at, low, size) -> Column:
        da, db = qa - pa, qb - pb
        v, one, two = (at - pb) * da, (low - pa) * db, (low + size - pa) * db
        return (db != 0) & (size != 0) & at.between(F.least(pb, qb), F.greatest(pb, qb)) & v.between(F.least(one, two), F.greatest(one, two))

    hits = [side(px, qx, py, qy, at, x, w) for at in (y, y + h)] + [side(py, qy, px, qx, at, y, h) for at in (x, x + w)]
    return F.coalesce(hits[0] | hits[1] | hits[2] | hits[3], F.lit(False))
