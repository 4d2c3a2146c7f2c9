"""Reference tables read from text: colour ranges by palette, named constants, keys that stand twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def colour_ranges(lines: DataFrame, palette: str) -> DataFrame:
    """(palette, colour, half, h_lo, s_lo, v_lo, h_hi, s_hi, v_hi) of ``colour_bound[_half] = h,s,v`` lines; other lines are skipped.

    A range without both bounds is left out. Rows are few: one for each range of a palette.
    """
    side = F.split("value", "=")
    rows = lines.filter(F.col("value").contains("=")).select(palette, F.split(F.trim(side[0]), "_").alias("name"), F.transform(F.split(F.trim(side[1]), ","), lambda x: F.trim(x).cast("int")).alias("at"))
    one = lambda bound: F.max(F.when(F.col("name")[1] == bound, F.col("at")))
    half = F.coalesce(F.get("name", F.lit(2)), F.lit(""))
    out = rows.groupBy(palette, F.col("name")[0].alias("colour"), half.alias("half")).agg(one("lower").alias("lo"), one("upper").alias("hi")).filter("lo is not null and hi is not null")
    return out.select(palette, "colour", "half", *(F.col(b)[k].alias(f"{c}_{b}") for b in ("lo", "hi") for k, c in enumerate("hsv")))


def colours_of(pixels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every (pixel, range) with hue, saturation and value inside; the ranges are a small reference table and are broadcast."""
    inside = [F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in "hsv"]
    return pixels.join(F.broadcast(ranges), inside[0] & inside[1] & inside[2])


def constant_code(constants: DataFrame, rows: DataFrame, name: str, code: str) -> DataFrame:
    """``rows`` with the code of the constant ``Kind.name`` in column ``name``; null where there is none."""
    known = constants.select(F.concat("kind", F.lit("."), "constant").alias(name), F.col("code").alias(code))
    return rows.join(F.broadcast(known), name, "left")


def constant_name(constants: DataFrame, rows: DataFrame, kind: str, code: str, name: str) -> DataFrame:
    """``rows`` with the name of a constant of one kind; a code without one stays as its digits."""
    known = constants.filter(F.col("kind") == kind).select(F.col("code").alias(code), F.col("constant").alias(name))
    return rows.join(F.broadcast(known), code, "left").withColumn(name, F.coalesce(name, F.col(code).cast("string")))


def duplicate_keys(rows: DataFrame, *key: Column) -> DataFrame:
    """(key columns, n) of keys that stand more than once in a reference table."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
