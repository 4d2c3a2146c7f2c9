"""Row-local box geometry. Boxes are columns x, y, w, h, imwidth, imheight; every function maps a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """Truncated toward zero."""
    return c.cast("int")


def centres(df: DataFrame) -> DataFrame:
    """cen_x, cen_y from corners, by truncating halves."""
    return df.withColumns({"cen_x": whole(F.col("x") + F.col("w") / 2), "cen_y": whole(F.col("y") + F.col("h") / 2)})


def corners(df: DataFrame) -> DataFrame:
    """x, y from centres, by truncating halves."""
    return df.withColumns({"x": whole(F.col("cen_x") - F.col("w") / 2), "y": whole(F.col("cen_y") - F.col("h") / 2)})


def to_relative(df: DataFrame) -> DataFrame:
    """Centre and size as shares of the image."""
    return df.withColumns({f"rel_{a}": F.col(a) / F.col("imwidth" if a in ("cen_x", "w") else "imheight") for a in ("cen_x", "cen_y", "w", "h")})


def to_absolute(df: DataFrame, whitespace: int = 0) -> DataFrame:
    """Centre and size in pixels of the image with its white space, truncated."""
    wide, high = F.col("imwidth") + whitespace, F.col("imheight") + whitespace
    return df.withColumns({"cen_x": whole(F.col("rel_cen_x") * wide), "cen_y": whole(F.col("rel_cen_y") * high), "w": whole(F.col("rel_w") * wide), "h": whole(F.col("rel_h") * high)})


def four_corners(df: DataFrame) -> DataFrame:
    """x2, y2; sizes below one become one."""
    out = df.withColumns({"w": F.when(F.col("w") <= 0, 1).otherwise(F.col("w")), "h": F.when(F.col("h") <= 0, 1).otherwise(F.col("h"))})
    return out.withColumns({"x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})


def unpad(df: DataFrame, whitespace: int) -> DataFrame:
    """Centres without half the white space, and relative values renewed."""
    half = whitespace // 2
    return to_relative(df.withColumns({"cen_x": F.col("cen_x") - half, "cen_y": F.col("cen_y") - half}))


def pad_image(df: DataFrame, whitespace: int) -> DataFrame:
    """Centres and image grown by white space."""
    half = whitespace // 2
    return df.withColumns({"cen_x": F.col("cen_x") + half, "cen_y": F.col("cen_y") + half, "imwidth": F.col("imwidth") + whitespace, "imheight": F.col("imheight") + whitespace})


def clip(df: DataFrame) -> DataFrame:
    """Corners inside the image; sizes cut at its far edges after that."""
    out = df.withColumns({a: F.greatest(F.col(a), F.lit(0)) for a in ("x", "y")})
    return out.withColumns({
        "w": F.when(F.col("x") + F.col("w") >= F.col("imwidth"), F.col("imwidth") - F.col("x")).otherwise(F.col("w")),
        "h": F.when(F.col("y") + F.col("h") >= F.col("imheight"), F.col("imheight") - F.col("y")).otherwise(F.col("h")),
    })


def pad(df: DataFrame, share: float) -> DataFrame:
    """Boxes grown by ``share`` of their size on every side."""
    grown = {a: F.col(a) - whole(F.lit(share) * F.col(b)) for a, b in (("x", "w"), ("y", "h"))}
    return df.withColumns(grown | {b: whole(F.lit(1 + 2 * share) * F.col(b)) for b in ("w", "h")})


def snap_full(df: DataFrame, share: float = 0.64) -> DataFrame:
    """Boxes over ``share`` of the image become the image."""
    large = F.col("w") * F.col("h") > F.lit(share) * F.col("imwidth") * F.col("imheight")
    return df.withColumns({"x": F.when(large, 0).otherwise(F.col("x")), "y": F.when(large, 0).otherwise(F.col("y")), "w": F.when(large, F.col("imwidth")).otherwise(F.col("w")), "h": F.when(large, F.col("imheight")).otherwise(F.col("h"))})


def full_truth(df: DataFrame) -> DataFrame:
    """Relative values of a box over the whole image."""
    return df.withColumns({"rel_cen_x": F.lit(0.5), "rel_cen_y": F.lit(0.5), "rel_w": F.lit(1.0), "rel_h": F.lit(1.0)})


def page_corners(df: DataFrame) -> DataFrame:
    """Corners as shares of the image."""
    return df.withColumns({"px0": F.col("x") / F.col("imwidth"), "py0": F.col("y") / F.col("imheight"), "px1": F.col("x2") / F.col("imwidth"), "py1": F.col("y2") / F.col("imheight")})


def area(w: Column, h: Column) -> Column:
    """Pixel-inclusive area."""
    return (w + 1) * (h + 1)


def magnified(df: DataFrame, padding: int = 30, pixels: float = 84000.0) -> DataFrame:
    """Boxes in the coordinates of an image padded and enlarged to about ``pixels``."""
    mag = F.greatest(F.lit(1.0), F.lit(pixels) / (F.col("imheight") * F.col("imwidth")))
    moved = {a: whole((F.col(a) + padding) * F.col("mag")) for a in ("x", "y")} | {a: whole(F.col(a) * F.col("mag")) for a in ("w", "h")}
    return df.withColumn("mag", mag).withColumns(moved)
