"""Precision, recall and error rates from matched boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.operators import overlap


def outcomes(truth: DataFrame, det: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """(image_id, outcome): TP, FP or FN of every detection by its nearest truth, and FN of untouched truths."""
    near = overlap.nearest_truth(truth, det)
    good = (F.col("t_class_id") == F.col("d_class_id")) & overlap.verdict(*(F.lit(x) for x in limits))
    kinds = F.when(F.col("t_box_id").isNull(), F.array(F.lit("FP"))).when(good, F.array(F.lit("TP"))).otherwise(F.array(F.lit("FP"), F.lit("FN")))
    found = near.select("image_id", F.explode(kinds).alias("outcome"))
    return found.unionByName(overlap.undetected(truth, det).select("image_id", F.lit("FN").alias("outcome")))


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn by group."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "FN")))


def thresholds(det: DataFrame, places: int = 4) -> DataFrame:
    """Distinct confidences, rounded."""
    return det.select(F.round("conf", places).alias("cut")).distinct()


def grid(conf: Column, places: int) -> Column:
    """The number of the last multiple of 10 ** -places that is not above ``conf``."""
    k = F.floor(conf * 10**places)
    at = lambda n: n / F.lit(float(10**places))
    return F.when(at(k + 1) <= conf, k + 1).when(at(k) > conf, k - 1).otherwise(k)


def swept(cands: DataFrame, truth: DataFrame, det: DataFrame, places: int = 4) -> DataFrame:
    """(cut, tp, fp, fn) for every confidence, rounded, as a cut: assigned pairs, other detections, other truths.

    An image's matching changes only at the confidences of its own candidates, so it is matched once for each of them and hands
    on the change of its matches there. Changes and detections are summed by the ``10 ** places`` multiples that a cut can be
    and then run down from the highest, so rows grow with the candidates, not with candidates times cuts.
    """
    own = cands.select("image_id", F.col("d_conf").alias("cut")).distinct()
    matched = overlap.assigned(cands.join(own, "image_id").filter("d_conf >= cut"), ["image_id", "cut"]).groupBy("image_id", "cut").agg(F.count("*").alias("n"))
    down = Window.partitionBy("image_id").orderBy(F.desc("cut"))
    change = own.join(matched, ["image_id", "cut"], "left").select("image_id", "cut", F.coalesce("n", F.lit(0)).alias("n"))
    change = change.select(grid(F.col("cut"), places).alias("k"), (F.col("n") - F.coalesce(F.lag("n").over(down), F.lit(0))).alias("tp"), F.lit(0).alias("dets"))
    seen = det.select(grid(F.col("conf"), places).alias("k"), F.lit(0).alias("tp"), F.lit(1).alias("dets"))
    asked = det.select(F.round(F.col("conf") * 10**places).cast("long").alias("k")).distinct().withColumn("cut", F.lit(True))
    sums = change.unionByName(seen).groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("dets").alias("dets"))
    rows = sums.join(asked, "k", "full").select("k", "cut", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("dets", F.lit(0)).alias("dets"))
    run = Window.orderBy(F.desc("k"))  # a row for each multiple
    rows = rows.select("k", "cut", F.sum("tp").over(run).alias("tp"), F.sum("dets").over(run).alias("dets")).filter("cut")
    rows = rows.crossJoin(F.broadcast(truth.agg(F.count("*").alias("truths"))))  # one row of totals
    return rows.select((F.col("k") / F.lit(float(10**places))).alias("cut"), "tp", (F.col("dets") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision and recall of each cut; points with both zero go."""
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    r = F.col("tp") / (F.col("tp") + F.col("fn")).cast("double")
    return counts.withColumns({"precision": p, "recall": r}).filter("precision > 0 or recall > 0")


def error_rates(counts: DataFrame) -> DataFrame:
    """(error_rate, predictions) of each cut, and the least rate at no predictions."""
    pos = F.col("tp") + F.col("fp")
    rows = counts.select((1 - F.coalesce(F.try_divide(F.col("tp").cast("double"), pos.cast("double")), F.lit(0.0))).alias("error_rate"), pos.alias("predictions"))
    return rows.unionByName(rows.agg(F.min("error_rate").alias("error_rate")).withColumn("predictions", F.lit(0).cast("long")))


def steps(curve: DataFrame, by: list[str]) -> DataFrame:
    """A step curve: predictions never fall as the error rate rises, with corner points where both rise."""
    order = Window.partitionBy(*by).orderBy("error_rate", "predictions")
    up = curve.withColumn("predictions", F.max("predictions").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy(*by).orderBy("error_rate", "predictions")
    ahead = up.withColumns({"e": F.lead("error_rate").over(order), "p": F.lead("predictions").over(order)})
    corner = ahead.filter((F.col("e") > F.col("error_rate")) & (F.col("p") > F.col("predictions"))).select(*by, F.col("e").alias("error_rate"), "predictions")
    return up.select(*by, "error_rate", "predictions").unionByName(corner)
