"""Evaluation queries: outcomes, curves and their shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import evaluation as ops
from sugarmill.operators import overlap
from sugarmill.plans import overlap as joins
from sugarmill.plans.base import DET, TRUTH, query
from sugarmill.sources import derived

OUTCOMES = joins.NEAR + f""",
nearest AS (SELECT *, CASE WHEN t_box_id IS NULL THEN ['FP'] WHEN t_class_id = d_class_id AND {joins.CURVE} THEN ['TP'] ELSE ['FP', 'FN'] END AS kinds FROM near WHERE n = 1),
outcomes AS (SELECT image_id, unnest(kinds) AS outcome FROM nearest UNION ALL SELECT image_id, 'FN' FROM truth WHERE box_id NOT IN (SELECT t_box_id FROM pairs))"""
COUNTS = "count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn"
#: Cuts of the curves: all confidences to four places. An image's matching changes at its own candidates' confidences only.
SWEEP = joins.CANDS + ", own AS (SELECT DISTINCT image_id, d_conf AS cut FROM cands), at_cut AS (SELECT o.cut, c.* FROM cands c JOIN own o ON c.image_id = o.image_id AND c.d_conf >= o.cut), " + joins.assigned_sql("at_cut", "cut, image_id") + """,
tps AS (SELECT image_id, cut, count(*) AS n FROM assigned GROUP BY ALL),
changes AS (SELECT cut, n - coalesce(lag(n) OVER (PARTITION BY image_id ORDER BY cut DESC), 0) AS tp FROM (SELECT own.image_id, own.cut, coalesce(n, 0) AS n FROM own LEFT JOIN tps ON own.image_id = tps.image_id AND own.cut = tps.cut)),
by_conf AS (SELECT conf, sum(tp) AS tp, sum(dets) AS dets FROM (SELECT cut AS conf, tp, 0 AS dets FROM changes UNION ALL SELECT conf, 0, 1 FROM det) GROUP BY conf),
cuts AS (SELECT DISTINCT round(conf, 4) AS cut FROM det),
sums AS (SELECT cut, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(dets), 0)::BIGINT AS dets FROM cuts LEFT JOIN by_conf ON conf >= cut GROUP BY cut),
counts AS (SELECT cut, tp, dets - tp AS fp, (SELECT count(*) FROM truth) - tp AS fn FROM sums)"""
RATES = """, rates0 AS (SELECT 1 - coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS error_rate, tp + fp AS predictions FROM counts),
rates AS (SELECT * FROM rates0 UNION ALL SELECT min(error_rate), 0 FROM rates0)"""
STEPS = """, up AS (SELECT error_rate, max(predictions) OVER (ORDER BY error_rate, predictions ROWS UNBOUNDED PRECEDING) AS predictions FROM rates),
ahead AS (SELECT *, lead(error_rate) OVER w AS e, lead(predictions) OVER w AS p FROM up WINDOW w AS (ORDER BY error_rate, predictions))
SELECT error_rate, predictions FROM up UNION ALL SELECT e, predictions FROM ahead WHERE e > error_rate AND p > predictions"""


def outcomes(spark, d):
    return ops.outcomes(derived.truth(spark, d), derived.detections(spark, d), overlap.PROFILES["curve"])


def counts(spark, d):
    return ops.swept(joins.cands(spark, d), derived.truth(spark, d), derived.detections(spark, d))


@query("eval_outcomes", f"WITH {OUTCOMES} SELECT image_id, outcome, count(*) AS n FROM outcomes GROUP BY ALL")
def eval_outcomes(spark, d):
    return outcomes(spark, d).groupBy("image_id", "outcome").agg(F.count("*").alias("n"))


@query("eval_counts", f"WITH {OUTCOMES} SELECT image_id, {COUNTS} FROM outcomes GROUP BY image_id")
def eval_counts(spark, d):
    return ops.counted(outcomes(spark, d), ["image_id"])


@query("eval_thresholds", f"WITH {DET} SELECT DISTINCT round(conf, 4) AS cut FROM det")
def eval_thresholds(spark, d):
    return ops.thresholds(derived.detections(spark, d))


@query("pr_curve", f"WITH RECURSIVE {SWEEP} SELECT * FROM (SELECT cut, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, tp / (tp + fn)::DOUBLE AS recall FROM counts) WHERE precision > 0 OR recall > 0")
def pr_curve(spark, d):
    return ops.precision_recall(counts(spark, d))


TENTHS = joins.DET + """,
both_det AS (SELECT 'plain' AS variant, * FROM det UNION ALL SELECT 'padded', det_id, image_id, class_id, x - CAST(trunc(0.2::DOUBLE * w) AS INT), y - CAST(trunc(0.2::DOUBLE * h) AS INT), CAST(trunc(1.4::DOUBLE * w) AS INT), CAST(trunc(1.4::DOUBLE * h) AS INT), conf FROM det),
p0 AS (SELECT d.variant, t.image_id, t.box_id AS t_box_id, t.class_id AS t_class_id, d.det_id AS d_det_id, d.class_id AS d_class_id, d.conf AS d_conf,
  (least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x) + 1) * (least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y) + 1) AS inter, (t.w + 1) * (t.h + 1) AS t_area, (d.w + 1) * (d.h + 1) AS d_area
  FROM truth t JOIN both_det d ON t.image_id = d.image_id AND t.x <= d.x + d.w AND d.x <= t.x + t.w AND t.y <= d.y + d.h AND d.y <= t.y + t.h),
pairs AS (SELECT *, inter / (t_area + d_area - inter)::DOUBLE AS iou FROM p0),
near AS (SELECT d.variant, d.conf, d.class_id AS d_class_id, p.t_box_id, p.t_class_id, p.inter, p.t_area, p.d_area, p.iou,
  row_number() OVER (PARTITION BY d.variant, d.det_id ORDER BY p.inter DESC NULLS LAST, p.t_box_id) AS n FROM both_det d LEFT JOIN pairs p ON d.det_id = p.d_det_id AND d.variant = p.variant),
kinds AS (SELECT variant, conf, unnest(CASE WHEN t_box_id IS NULL THEN ['FP'] WHEN t_class_id = d_class_id AND """ + joins.VERDICT.format(c=0.95, s=0.95, o=0.25) + """ THEN ['TP'] ELSE ['FP', 'FN'] END) AS outcome FROM near WHERE n = 1),
touched AS (SELECT variant, t_box_id, max(d_conf) AS top FROM pairs GROUP BY ALL),
truths AS (SELECT v.variant, t.box_id, coalesce(h.top, -1) AS top FROM truth t CROSS JOIN (VALUES ('plain'), ('padded')) v(variant) LEFT JOIN touched h ON h.variant = v.variant AND h.t_box_id = t.box_id),
cuts AS (SELECT unnest(range(10)) / 10::DOUBLE AS cut)
SELECT variant, cut, (SELECT count(*) FROM kinds k WHERE k.variant = v.variant AND outcome = 'TP' AND conf >= cut) AS tp, (SELECT count(*) FROM kinds k WHERE k.variant = v.variant AND outcome = 'FP' AND conf >= cut) AS fp,
  (SELECT count(*) FROM kinds k WHERE k.variant = v.variant AND outcome = 'FN' AND conf >= cut) + (SELECT count(*) FROM truths t WHERE t.variant = v.variant AND top < cut) AS fn
FROM cuts CROSS JOIN (VALUES ('plain'), ('padded')) v(variant)"""


@query("pr_tenths", f"WITH {TENTHS}")
def pr_tenths(spark, d):
    from sugarmill.operators import boxes

    t, det = derived.truth(spark, d), derived.detections(spark, d)
    cuts = F.broadcast(spark.range(10).select((F.col("id") / 10).alias("cut")))
    out = None
    for variant, boxed in (("plain", det), ("padded", boxes.pad(det, 0.2))):
        near = overlap.nearest_truth(t, boxed)
        good = (F.col("t_class_id") == F.col("d_class_id")) & overlap.verdict(*(F.lit(x) for x in overlap.PROFILES["padded"]))
        kinds = near.select("d_conf", F.explode(F.when(F.col("t_box_id").isNull(), F.array(F.lit("FP"))).when(good, F.array(F.lit("TP"))).otherwise(F.array(F.lit("FP"), F.lit("FN")))).alias("outcome"))
        top = overlap.paired(t, boxed).groupBy("t_box_id").agg(F.max("d_conf").alias("top"))
        never = t.join(top, t.box_id == top.t_box_id, "left").select(F.coalesce("top", F.lit(-1.0)).alias("top"))
        by_cut = kinds.join(cuts, F.col("d_conf") >= F.col("cut")).select("cut", "outcome").unionByName(never.join(cuts, F.col("top") < F.col("cut")).select("cut", F.lit("FN").alias("outcome")))
        one = ops.counted(by_cut, ["cut"]).withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return out


@query("qvalue_boxes", f"WITH RECURSIVE {SWEEP}{RATES} SELECT * FROM rates")
def qvalue_boxes(spark, d):
    return ops.error_rates(counts(spark, d))


@query("qvalue_steps", f"WITH RECURSIVE {SWEEP}{RATES}{STEPS}")
def qvalue_steps(spark, d):
    return ops.steps(ops.error_rates(counts(spark, d)).withColumn("model", F.lit("all")), ["model"]).drop("model")


COMP = TRUTH + """, pred AS (SELECT box_id, image_id, CASE WHEN box_id % 29 = 0 THEN (class_id + 1) % 8 ELSE class_id END AS class_id, 0.5 + ((box_id * 7919) % 500)::DOUBLE / 1000 AS conf FROM truth),
both_counts AS (SELECT image_id, class_id, sum(a) AS a, sum(b) AS b FROM (SELECT image_id, class_id, 1 AS a, 0 AS b FROM truth UNION ALL SELECT image_id, class_id, 0, 1 FROM pred) GROUP BY ALL),
checked AS (SELECT image_id, bool_and(a = b) AS exact, sum(a) = sum(b) AS totals FROM both_counts GROUP BY image_id)"""


def predicted(spark, d):
    return derived.truth(spark, d).selectExpr("box_id", "image_id", "case when box_id % 29 = 0 then (class_id + 1) % 8 else class_id end as class_id", "0.5 + cast((box_id * 7919) % 500 as double) / 1000 as conf")


def checked(spark, d):
    both = derived.truth(spark, d).select("image_id", "class_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(predicted(spark, d).select("image_id", "class_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.groupBy("image_id", "class_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return n.groupBy("image_id").agg(F.bool_and(F.col("a") == F.col("b")).alias("exact"), (F.sum("a") == F.sum("b")).alias("totals"))


@query("composition_check", f"WITH {COMP} SELECT * FROM checked")
def composition_check(spark, d):
    return checked(spark, d)


@query("qvalue_composition", f"WITH {COMP}, m AS (SELECT image_id, min(conf) AS low FROM pred GROUP BY 1), cuts AS (SELECT unnest(range(10)) / 20::DOUBLE + 0.5 AS cut), c AS (SELECT cut, count(*) FILTER (exact) AS tp, count(*) AS n FROM m JOIN checked USING (image_id) JOIN cuts ON low >= cut GROUP BY cut) SELECT cut, tp, n - tp AS fp, 1 - tp / n::DOUBLE AS error_rate, n AS predictions FROM c")
def qvalue_composition(spark, d):
    low = predicted(spark, d).groupBy("image_id").agg(F.min("conf").alias("low"))
    cuts = F.broadcast(spark.range(10).select((F.col("id") / 20 + 0.5).alias("cut")))
    c = low.join(checked(spark, d), "image_id").join(cuts, F.col("low") >= F.col("cut")).groupBy("cut").agg(F.count_if("exact").alias("tp"), F.count("*").alias("predictions"))
    return c.select("cut", "tp", (F.col("predictions") - F.col("tp")).alias("fp"), (1 - F.col("tp") / F.col("predictions").cast("double")).alias("error_rate"), "predictions")


ROOTS = joins.PAIRS + f""", root AS (SELECT image_id, min(box_id) AS box_id FROM truth GROUP BY 1), best AS (SELECT image_id, max_by(det_id, conf * 1e8 - det_id / 1e8) AS det_id, max(conf) AS conf FROM det GROUP BY 1),
hit AS (SELECT b.image_id, b.conf, coalesce(bool_or({joins.VERDICT.format(c=0.5, s=0.5, o=0.5)}), FALSE) AS good FROM best b JOIN root r USING (image_id) LEFT JOIN pairs p ON p.t_box_id = r.box_id AND p.d_det_id = b.det_id GROUP BY ALL),
cuts AS (SELECT unnest(range(10)) / 10::DOUBLE AS cut)"""


@query("qvalue_root", f"WITH {ROOTS} SELECT cut, count(*) FILTER (good) AS tp, count(*) FILTER (NOT good) AS fp, 1 - count(*) FILTER (good) / count(*)::DOUBLE AS error_rate FROM hit JOIN cuts ON conf >= cut GROUP BY cut")
def qvalue_root(spark, d):
    t = derived.truth(spark, d)
    root = t.groupBy("image_id").agg(F.min("box_id").alias("root_id"))
    top = derived.detections(spark, d).groupBy("image_id").agg(F.max_by("det_id", F.struct("conf", -F.col("det_id"))).alias("best_id"), F.max("conf").alias("conf"))
    good = joins.pairs(spark, d).filter(overlap.verdict(*(F.lit(x) for x in overlap.PROFILES["root"]))).select(F.col("t_box_id").alias("root_id"), F.col("d_det_id").alias("best_id"), F.lit(True).alias("good"))
    cuts = F.broadcast(spark.range(10).select((F.col("id") / 10).alias("cut")))
    hit = top.join(root, "image_id").join(good, ["root_id", "best_id"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    c = hit.join(cuts, F.col("conf") >= F.col("cut")).groupBy("cut").agg(F.count_if("good").alias("tp"), F.count("*").alias("n"))
    return c.select("cut", "tp", (F.col("n") - F.col("tp")).alias("fp"), (1 - F.col("tp") / F.col("n").cast("double")).alias("error_rate"))


@query("eval_max_predictions", f"WITH {TRUTH} SELECT count(DISTINCT box_id) AS truths, count(DISTINCT image_id) AS images FROM truth")
def eval_max_predictions(spark, d):
    return derived.truth(spark, d).agg(F.countDistinct("box_id").alias("truths"), F.countDistinct("image_id").alias("images"))


@query("eval_by_model", f"WITH {OUTCOMES}, m AS (SELECT 'm' || image_id % 3 AS model, outcome FROM outcomes) SELECT coalesce(model, 'all') AS model, {COUNTS} FROM m GROUP BY GROUPING SETS ((model), ())")
def eval_by_model(spark, d):
    rows = outcomes(spark, d).select(F.concat(F.lit("m"), F.col("image_id") % 3).alias("model"), "outcome")
    rows = rows.rollup("model").agg(*(F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "FN")))
    return rows.withColumn("model", F.coalesce("model", F.lit("all")))


@query("eval_sample", f"WITH {TRUTH} SELECT image_id FROM (SELECT DISTINCT image_id FROM truth) ORDER BY (image_id * 7919) % 10007, image_id LIMIT 100")
def eval_sample(spark, d):
    return derived.truth(spark, d).select("image_id").distinct().orderBy((F.col("image_id") * 7919) % 10007, "image_id").limit(100)
