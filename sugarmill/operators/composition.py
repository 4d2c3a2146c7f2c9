"""Compositions as long tables of (key, symbol, n), and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.sources.derived import SYMBOLS


def wide(rows: DataFrame, key: str, symbol: str = "symbol") -> DataFrame:
    """One column of counts for each symbol; symbols that are missing count 0."""
    return rows.groupBy(key).pivot(symbol, list(SYMBOLS)).count().fillna(0)


def text(rows: DataFrame, key: str, symbol: str = "symbol", n: str = "n") -> DataFrame:
    """(key, composition): ``Sym(n)`` by symbol for counts above zero."""
    one = F.struct(F.col(symbol), F.concat(F.col(symbol), F.lit("("), F.col(n).cast("string"), F.lit(")")).alias("t"))
    return rows.filter(F.col(n) > 0).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("composition"))


def combined(left: DataFrame, right: DataFrame, key: str, sign: int) -> DataFrame:
    """Element-wise sum or difference."""
    both = left.select(key, "symbol", F.col("n").cast("long").alias("n")).unionByName(right.select(key, "symbol", (sign * F.col("n")).cast("long").alias("n")))
    return both.groupBy(key, "symbol").agg(F.sum("n").alias("n"))


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, contains, equal) over the right side's symbols."""
    rows = right.select(key, "symbol", F.col("n").alias("r")).join(left.select(key, "symbol", F.col("n").alias("l")), [key, "symbol"], "left").withColumn("l", F.coalesce("l", F.lit(0)))
    return rows.groupBy(key).agg(F.bool_and(F.col("l") >= F.col("r")).alias("contains"), F.bool_and(F.col("l") == F.col("r")).alias("equal"))


def parsed_formula(rows: DataFrame, key: str, formula: str) -> DataFrame:
    """(key, element, n) of formulas such as C6H12O6."""
    parts = F.expr(f"regexp_extract_all({formula}, '([A-Z][a-z]?)([0-9]*)', 0)")
    out = rows.select(key, F.explode(parts).alias("p")).select(key, F.regexp_extract("p", "^[A-Za-z]+", 0).alias("element"), F.regexp_extract("p", "[0-9]+", 0).alias("d"))
    return out.select(key, "element", F.when(F.col("d") == "", 1).otherwise(F.expr("try_cast(d as int)")).alias("n"))


def formula_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, formula): elements by name, counts above one written."""
    one = F.struct("element", F.concat("element", F.when(F.col("n") == 1, "").otherwise(F.col("n").cast("string"))).alias("t"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("formula"))
