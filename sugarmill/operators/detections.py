"""Decoding network rows and thinning detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.operators import boxes


def arg_max(df: DataFrame) -> DataFrame:
    """class_id and conf: the first largest score."""
    return df.withColumns({"conf": F.array_max("scores"), "class_id": (F.array_position("scores", F.array_max("scores")) - 1).cast("int")})


def class_options(df: DataFrame) -> DataFrame:
    """options: scores above zero with their classes, largest first; several: whether there are more than one."""
    numbered = F.transform("scores", lambda s, i: F.struct((-s).alias("neg"), i.cast("int").alias("class_id"), s.alias("conf")))
    ordered = F.array_sort(F.filter(numbered, lambda x: x["conf"] > 0))
    out = df.withColumn("options", F.transform(ordered, lambda x: F.struct(x["class_id"].alias("class_id"), x["conf"].alias("conf"))))
    return out.withColumn("several", F.size("options") > 1)


def decode(df: DataFrame, whitespace: int = 200, padding: float = 0.0) -> DataFrame:
    """Network rows as boxes: absolute, without white space, with corners, padded if asked, clipped, snapped, four corners."""
    out = boxes.corners(boxes.unpad(boxes.to_absolute(df, whitespace), whitespace))
    if padding:
        out = boxes.pad(out, padding)
    return boxes.four_corners(boxes.snap_full(boxes.clip(out)))


def rectangle_iou(a: Column, b: Column) -> Column:
    """Intersection over union of half-open rectangles."""
    wide = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = wide * high
    return inter / (a["w"] * a["h"] + b["w"] * b["h"] - inter)


def non_max_suppression(df: DataFrame, threshold: float = 0.0, limit: float = 0.4, image: str = "image_id", key: str = "det_id") -> DataFrame:
    """The detections that a greedy pass by confidence keeps: none overlaps a kept one by more than ``limit``.

    A network gives a bounded number of rows for an image, so an image's boxes fold in one aggregate after one shuffle.
    """
    columns = [key, "x", "y", "w", "h", "conf"]
    box = F.struct((-F.col("conf")).alias("neg"), *columns)
    groups = df.filter(F.col("conf") > threshold).groupBy(image).agg(F.array_sort(F.collect_list(box)).alias("ranked"))
    none = F.filter("ranked", lambda b: F.lit(False))
    kept = F.aggregate("ranked", none, lambda kept, b: F.when(F.exists(kept, lambda k: rectangle_iou(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))
    return groups.select(image, F.explode(kept).alias("b")).select(image, *(F.col("b")[c].alias(c) for c in columns))


def at_least(df: DataFrame, threshold: float) -> DataFrame:
    """Detections of at least a confidence."""
    return df.filter(F.col("conf") >= threshold)


def has_glycan(images: DataFrame, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For every image, whether a detection reaches the threshold; false without detections."""
    found = df.groupBy("image_id").agg(F.bool_or(F.col("conf") >= threshold).alias("found"))
    return images.join(found, "image_id", "left").select("image_id", F.coalesce("found", F.lit(False)).alias("has_glycan"))


def best(images: DataFrame, df: DataFrame) -> DataFrame:
    """For every image its most confident detection, the first of equals; null without any."""
    top = df.groupBy("image_id").agg(F.max_by(F.struct("det_id", "class_id", "conf"), F.struct("conf", -F.col("det_id"))).alias("b"))
    return images.join(top, "image_id", "left").select("image_id", "b.det_id", "b.class_id", "b.conf")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
