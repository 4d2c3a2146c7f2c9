"""Symbols from pixels: colour classes, regions, shapes. Pixels are rows (image_id, y, x, b, g, r)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def hsv(df: DataFrame) -> DataFrame:
    """h in 0 to 180, s and v in 0 to 255, as 8-bit images have them."""
    v, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    span = (v - low).cast("double")
    sector = F.when(F.col("r") == v, (F.col("g") - F.col("b")) / span).when(F.col("g") == v, 2 + (F.col("b") - F.col("r")) / span).otherwise(4 + (F.col("r") - F.col("g")) / span)
    hue = F.when(v == low, F.lit(0.0)).otherwise(30 * sector)
    return df.withColumns({"h": F.floor(F.when(hue < 0, hue + 180).otherwise(hue) + 0.5).cast("int"), "s": F.when(v == 0, 0).otherwise(F.floor(255 * span / v + 0.5)).cast("int"), "v": v})


def coloured(df: DataFrame, colours: DataFrame) -> DataFrame:
    """Each (pixel, colour) whose range holds the pixel; a pixel may have several colours. ``colours`` is a small fixed table.

    A pixel is looked at once and gives each of its colours once: a colour's ranges are one condition, compiled with the rest of the
    plan; a join by the ranges tries every pair, and its rows must be made distinct after it. A pixel is one row of ``df``.
    """
    ranges: dict[str, Column] = {}
    for k in colours.collect():  # a fixed table of a few ranges
        held = F.col("h").between(k.h_lo, k.h_hi) & F.col("s").between(k.s_lo, k.s_hi) & F.col("v").between(k.v_lo, k.v_hi)
        ranges[k.colour] = ranges[k.colour] | held if k.colour in ranges else held
    names = F.array(*(F.when(held, name) for name, held in ranges.items())).cast("array<string>")
    return df.select("image_id", "y", "x", F.explode(names).alias("colour")).filter("colour is not null")


def overlapping(line: np.ndarray, low: np.ndarray, high: np.ndarray, lines: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of intervals of the first and of the second kind that share a pixel of a line. Those of the second kind are in
    the order of lines and columns and apart from each other."""
    if not len(line) or not len(lines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = min(low.min(), lows.min())
    width = max(high.max(), highs.max()) - least + 2
    begin = np.searchsorted(lines * width + highs - least, line * width + low - least)
    n = np.maximum(np.searchsorted(lines * width + lows - least, line * width + high - least, "right") - begin, 0)
    return np.repeat(np.arange(len(line)), n), np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def first_of_region(ys: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each run of pixels, in the order of lines and columns, the first run that it is joined with."""
    line, low, high = (np.asarray(x, np.int64) for x in (ys, lows, highs))
    root = np.arange(len(line))
    i, j = overlapping(line - 1, low - 1, high + 1, line, low, high)
    while len(i):
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def inner_pixels(ys: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each run of pixels, in the order of lines and columns, how many of its pixels have all four neighbours in some run."""
    line, low, high = (np.asarray(x, np.int64) for x in (ys, lows, highs))
    i, j = overlapping(line - 1, low, high, line + 1, low, high)
    between, left, right = line[i] - 1, np.maximum(low[i], low[j]), np.minimum(high[i], high[j])  # what the lines above and below both have
    i, j = overlapping(line, low + 1, high - 1, between, left, right)
    shared = np.minimum(high[i] - 1, right[j]) - np.maximum(low[i] + 1, left[j]) + 1
    return np.bincount(i, np.maximum(shared, 0), len(line)).astype(np.int64)


REGION = "begin struct<y:bigint,x1:bigint,x2:bigint,n:bigint>, x int, y int, w int, h int, n bigint, inner bigint"


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions of groups (image_id, colour, runs), all groups of a batch at once: the lines of each stand below those of the one before."""
    for batch in batches:
        group = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("runs")).to_numpy())
        if not len(group):
            continue
        runs = batch.column("runs").flatten()
        y, x1, x2, n = (runs.field(c).to_numpy() for c in ("y", "x1", "x2", "n"))
        place = group * (y.max() - y.min() + 3) + y, x1, x2
        first, inner = first_of_region(*place), inner_pixels(*place)
        order = np.argsort(first, kind="stable")
        begin = np.flatnonzero(first == np.arange(len(first)))
        at = np.searchsorted(first[order], begin)
        of = lambda f, x: f.reduceat(x[order], at)
        left = of(np.minimum, x1)
        of_region = [left, y[begin], of(np.maximum, x2) - left + 1, of(np.maximum, y) - y[begin] + 1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(group[begin])) for c in ("image_id", "colour")), runs.take(pa.array(begin)), *(pa.array(x, pa.int32()) for x in of_region), pa.array(of(np.add, n)), pa.array(of(np.add, inner))],
            names=["image_id", "colour", "begin", "x", "y", "w", "h", "n", "inner"],
        )


def areas(pixels: DataFrame) -> DataFrame:
    """(image_id, colour, begin, x, y, w, h, n, area): as ``regions``, each named by its first run (y, x1, x2, n), with the area that its outline
    encloses where it goes through the middles of the border pixels: pixels - border pixels / 2 - 1. A pixel is on the border if one of its four
    neighbours is not of the region; holes are not filled.
    """
    return measured(pixels).withColumn("area", F.col("n") - (F.col("n") - F.col("inner")) / 2 - 1).select("image_id", "colour", "begin", "x", "y", "w", "h", "n", "area")


def grey(df: DataFrame) -> DataFrame:
    """grey: the brightness of a pixel, 0 to 255, in hundredths of 30 red, 59 green and 11 blue."""
    return df.withColumn("grey", F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114 + 500) / 1000).cast("int"))


def largest_dark(df: DataFrame, most: int = 230) -> DataFrame:
    """The largest region of each image whose pixels are at most ``most`` bright, over all colours; the last of equals in order of begin."""
    found = areas(grey(df).filter(F.col("grey") <= most).select("image_id", F.lit("dark").alias("colour"), "y", "x"))
    best = F.max_by(F.struct("begin", "x", "y", "w", "h", "n", "area"), F.struct("area", "begin")).alias("b")
    return found.groupBy("image_id").agg(best).select("image_id", "b.*")


def regions(pixels: DataFrame) -> DataFrame:
    """(image_id, colour, region, x, y, w, h, n): 8-connected regions with their boxes, from rows of (image_id, colour, y, x).

    Rows of touching pixels become runs. An image bounds its runs of a colour, so they are joined in one pass after one shuffle;
    a region is named by its first pixel.
    """
    name = (F.col("begin.y") * 100000 + F.col("begin.x1")).alias("region")
    return measured(pixels).select("image_id", "colour", name, "x", "y", "w", "h", "n")


def measured(pixels: DataFrame) -> DataFrame:
    """(image_id, colour, begin, x, y, w, h, n, inner): regions by their first run, with their pixels and those that are no border."""
    line = Window.partitionBy("image_id", "colour", "y").orderBy("x")
    runs = pixels.withColumn("gap", F.col("x") - F.row_number().over(line)).groupBy("image_id", "colour", "y", "gap").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.count("*").alias("n"))
    one = F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "x1", "x2", "n")))
    groups = runs.groupBy("image_id", "colour").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    return groups.mapInArrow(joined_runs, T.StructType([*groups.drop("runs").schema.fields, *T.StructType.fromDDL(REGION).fields]))


def shaped(df: DataFrame, image_area: float, squareness: float = 0.25, share: float = 1000.0, fill: float = 500.0, size: str = "n") -> DataFrame:
    """Regions that are square, large and full enough; by the column ``size``."""
    out = df.withColumns({"squareness": F.abs(F.log2(F.col("w") / F.col("h").cast("double"))), "share": 1e6 * F.col(size) / image_area, "fullness": 1000.0 * F.col(size) / (F.col("w") * F.col("h"))})
    return out.filter((F.col("squareness") <= squareness) & (F.col("share") >= share) & (F.col("fullness") >= fill))


def symbol_of(colour: Column, fill: Column) -> Column:
    """The symbol of a colour and the share of its box that it fills; null if none fits."""
    return (
        F.when(colour == "red", "Fuc").when(colour == "purple", "NeuAc").when(colour == "green", "Man")
        .when((colour == "blue") & (fill >= 0.8), "GlcNAc").when((colour == "blue") & (fill > 0.5), "Glc")
        .when((colour == "yellow") & (fill > 0.9), "GalNAc").when((colour == "yellow") & (fill > 0.5), "Gal")
    )
