"""Linking the symbols of an image by the lines between them, and choosing its root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.operators.overlap import segment_hits_rectangle


def mean_distance(monos: DataFrame) -> DataFrame:
    """(image_id, distance): 100 and each symbol's distance to its nearest other, over the number of symbols."""
    a = monos.select("image_id", F.col("mono_idx").alias("i"), F.col("cen_x").alias("ax"), F.col("cen_y").alias("ay"))
    b = monos.select(F.col("image_id"), F.col("mono_idx").alias("j"), F.col("cen_x").alias("bx"), F.col("cen_y").alias("by"))
    far = F.sqrt(((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))).cast("double"))
    near = a.join(b, "image_id").filter("i <> j").groupBy("image_id", "i").agg(F.min(far).alias("d")).groupBy("image_id").agg(F.sum("d").alias("s"))
    n = monos.groupBy("image_id").agg(F.count("*").alias("n"))
    return n.join(near, "image_id", "left").select("image_id", ((F.coalesce("s", F.lit(0.0)) + 100) / F.col("n")).alias("distance"))


def windows(monos: DataFrame, factor: float = 1.2) -> DataFrame:
    """Each symbol's search window: half the diagonal times a factor, clipped to the image."""
    r = F.expr(f"cast(sqrt(cast(h * h + w * w as double)) / 2 * {factor}D as int)")
    out = monos.withColumn("radius", r)
    return out.withColumns({
        "x1": F.greatest(F.col("cen_x") - F.col("radius"), F.lit(0)), "y1": F.greatest(F.col("cen_y") - F.col("radius"), F.lit(0)),
        "x2": F.least(F.col("cen_x") + F.col("radius"), F.col("imwidth")), "y2": F.least(F.col("cen_y") + F.col("radius"), F.col("imheight")),
    })


#: Steps of a ray beyond its line, in hundredths of the mean distance.
STEPS = (1, 196, 5)
FAR = 1e9


def crossing(at: tuple[str, str], inverse: tuple[str, str], box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """The distances at which a ray from a point enters and leaves a box, by one over its direction, null for none; entering lies behind leaving where it misses."""
    ends = []
    for axis in (0, 1):
        m, by, low, high = F.col(at[axis]), F.col(inverse[axis]), box[axis], box[axis + 2]
        inside, one, two = m.between(low, high), (low - m) * by, (high - m) * by
        ends.append((F.coalesce(F.least(one, two), F.when(inside, -FAR).otherwise(FAR)), F.coalesce(F.greatest(one, two), F.when(inside, FAR).otherwise(-FAR))))
    return F.greatest(ends[0][0], ends[1][0]), F.least(ends[0][1], ends[1][1])


def ray_links(monos: DataFrame, contours: DataFrame, distance: DataFrame) -> DataFrame:
    """(image_id, a, b), a < b: rays from a symbol through the line contours in its window, in 40 steps, to the first other symbol hit.

    A step's end is cut to whole pixels, so a ray lies within a pixel of the straight one. It can't hit before the straight one
    enters the box two pixels wider, and has hit once that one is two pixels inside: only the steps between are tried.
    """
    seen = windows(monos, 1.5).join(contours, "image_id").filter("cx between x1 and x2 and cy between y1 and y2").join(distance, "image_id")
    seen = seen.select("image_id", "mono_idx", "contour_idx", "cen_x", "cen_y", "cx", "cy", "distance")
    seen = seen.withColumn("len", F.greatest(F.sqrt(((F.col("cen_x") - F.col("cx")) * (F.col("cen_x") - F.col("cx")) + (F.col("cen_y") - F.col("cy")) * (F.col("cen_y") - F.col("cy"))).cast("double")), F.lit(1.0)))
    seen = seen.withColumns({"ux": (F.col("cx") - F.col("cen_x")) / F.col("len"), "uy": (F.col("cy") - F.col("cen_y")) / F.col("len")})
    first, last, by = STEPS
    end = lambda axis, step: (F.col(f"c{axis}") + F.col(f"u{axis}") * (F.col("distance") * (step / 100))).cast("int")
    seen = seen.withColumns({"fx": end("x", F.lit(last)), "fy": end("y", F.lit(last)), "mx": F.col("cen_x").cast("double"), "my": F.col("cen_y").cast("double"), "ix": F.when(F.col("ux") != 0, 1 / F.col("ux")), "iy": F.when(F.col("uy") != 0, 1 / F.col("uy"))})
    number = lambda t: F.least(F.greatest(F.ceil(((t - F.col("len")) * 100 / F.col("distance") - first) / by), F.lit(0)), F.lit((last - first) // by)) * by + first
    ox, oy, ow, oh = (F.col(c) for c in ("ox", "oy", "ow", "oh"))
    grown = lambda k: (ox - k, oy - k, ox + ow + k, oy + oh + k)
    boxes = (F.col(c).cast("double").alias(f"o{c}") for c in "xywh")
    other = monos.select("image_id", F.col("mono_idx").alias("other"), *boxes)
    near = seen.join(other, "image_id").filter("other <> mono_idx")
    near = near.filter("ox <= greatest(cen_x, cx, fx) + 1 and ox + ow >= least(cen_x, cx, fx) - 1 and oy <= greatest(cen_y, cy, fy) + 1 and oy + oh >= least(cen_y, cy, fy) - 1")
    for name, k in (("wide", 2), ("narrow", -2)):
        near = near.withColumns(dict(zip((name, name + "_end"), crossing(("mx", "my"), ("ix", "iy"), grown(k)), strict=True)))
    outside = ~(F.col("cen_x").between(F.col("ox"), F.col("ox") + F.col("ow")) & F.col("cen_y").between(F.col("oy"), F.col("oy") + F.col("oh")))
    sure = F.when(outside & F.expr("narrow <= narrow_end and narrow >= 0"), number(F.col("narrow"))).otherwise(last)
    near = near.withColumns({"least": number(F.col("wide")), "sure": sure})
    # ends are worked out with the steps, and a miss has none: as filters both would be written out in each use
    steps = F.when(F.expr("wide <= wide_end and wide_end >= 0"), F.sequence("least", F.greatest("least", "sure"), F.lit(by).cast("long")))
    tried = near.select("image_id", "mono_idx", "contour_idx", "mx", "my", "other", "ox", "oy", "ow", "oh", F.explode(F.transform(steps, lambda s: F.struct(s.alias("step"), end("x", s).cast("double").alias("qx"), end("y", s).cast("double").alias("qy")))).alias("s")).select("*", "s.*")
    hit = segment_hits_rectangle(*(F.col(c) for c in ("mx", "my", "qx", "qy", "ox", "oy", "ow", "oh")))
    first_hit = tried.filter(hit).groupBy("image_id", "mono_idx", "contour_idx").agg(F.min_by("other", F.struct("step", "other")).alias("target"))
    return first_hit.select("image_id", F.least("mono_idx", "target").alias("a"), F.greatest("mono_idx", "target").alias("b")).distinct()


def orientation_vote(links: DataFrame, monos: DataFrame) -> DataFrame:
    """(image_id, orientation): 1 if at least as many links are wider than tall, else 3."""
    at = monos.select("image_id", "mono_idx", "cen_x", "cen_y")
    rows = links.join(at.select("image_id", F.col("mono_idx").alias("a"), F.col("cen_x").alias("ax"), F.col("cen_y").alias("ay")), ["image_id", "a"]).join(at.select("image_id", F.col("mono_idx").alias("b"), F.col("cen_x").alias("bx"), F.col("cen_y").alias("by")), ["image_id", "b"])
    wide, tall = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    return rows.groupBy("image_id").agg(F.when(F.count_if(wide > tall) >= F.count_if(tall > wide), 1).otherwise(3).alias("orientation"))


def root_by_orientation(monos: DataFrame) -> DataFrame:
    """(image_id, mono_idx): the first symbol that is no fucose, along the image's orientation (0 and 1: x up and down, 2 and 3: y; null: list order)."""
    key = F.when(F.col("orientation") == 0, F.col("cen_x")).when(F.col("orientation") == 1, -F.col("cen_x")).when(F.col("orientation") == 2, F.col("cen_y")).when(F.col("orientation") == 3, -F.col("cen_y")).otherwise(F.lit(0))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(key, "mono_idx"))
    return monos.filter("symbol <> 'Fuc'").withColumn("n", n).filter("n = 1").select("image_id", "mono_idx")
