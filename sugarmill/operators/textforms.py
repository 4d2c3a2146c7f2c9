"""Reading and writing the text forms: box rows, key-value logs, structure text. Input is lines as ``spark.read.text`` gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def truth_rows(lines: DataFrame, key: str) -> DataFrame:
    """``class cx cy w h`` lines as (key, class_id, rel_cen_x, rel_cen_y, rel_w, rel_h); blank lines are skipped."""
    p = F.split(F.trim("value"), " +")
    out = lines.filter(F.trim("value") != "").select(key, p.alias("p"))
    return out.select(key, F.col("p")[0].cast("int").alias("class_id"), *(F.col("p")[k].cast("double").alias(c) for k, c in enumerate(("rel_cen_x", "rel_cen_y", "rel_w", "rel_h"), 1)))


def composition_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, symbol, n) of ``composition : word word symbol count symbol count ...`` lines; other keys are skipped."""
    p = F.split(F.col("value"), " : ", 2)
    rows = lines.select(key, F.trim(p[0]).alias("k"), F.split(F.trim(p[1]), " +").alias("w")).filter("k = 'composition'")
    rows = rows.select(key, F.posexplode(F.slice("w", F.lit(3), F.greatest(F.size("w") - 2, F.lit(0)))).alias("at", "symbol"), "w")
    return rows.filter("at % 2 = 0").select(key, "symbol", F.try_element_at("w", F.col("at") + 4).cast("int").alias("n"))


def structure_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, section): non-empty lines with the section they stand in."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).filter("line <> ''")
    head = F.when(F.col("line").isin("RES", "LIN", "UND"), F.col("line"))
    return rows.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))).withColumn("head", head.isNotNull())


RESIDUE = r"^(\d+)(b|s):(?:([abx])-)?(.*)$"
LINK = r"^(\d+):(\d+)([a-z])\((-?\d+)\+(-?\d+)\)(\d+)([a-z])$"


def structure_residues(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, residue, kind, anomer, body) of the residue section."""
    rows = structure_lines(docs, key, text).filter("section = 'RES' and not head").filter(F.col("line").rlike(RESIDUE))
    part = lambda k: F.regexp_extract("line", RESIDUE, k)
    return rows.select(key, part(1).cast("int").alias("residue"), part(2).alias("kind"), F.nullif(part(3), F.lit("")).alias("anomer"), part(4).alias("body"))


def structure_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, link, parent, parent_type, parent_pos, child_pos, child, child_type) of the link section; position -1 is unknown."""
    rows = structure_lines(docs, key, text).filter("section = 'LIN' and not head").filter(F.col("line").rlike(LINK))
    part = lambda k: F.regexp_extract("line", LINK, k)
    whole = lambda k: part(k).cast("int")
    return rows.select(key, whole(1).alias("link"), whole(2).alias("parent"), part(3).alias("parent_type"), F.nullif(whole(4), F.lit(-1)).alias("parent_pos"), F.nullif(whole(5), F.lit(-1)).alias("child_pos"), whole(6).alias("child"), part(7).alias("child_type"))


def structure_rejects(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) of texts that cannot be read: the first that holds of LIN first, repeated section, bad line, missing parent, missing child, backwards link."""
    lines = structure_lines(docs, key, text)
    bad = F.when(F.col("section") == "RES", ~F.col("line").rlike(RESIDUE)).when(F.col("section") == "LIN", ~F.col("line").rlike(LINK)).otherwise(F.lit(True))
    shape = lines.groupBy(key).agg(
        F.min(F.when(F.col("head"), F.struct("at", "line")))["line"].alias("first_head"), F.count_if(F.col("head") & (F.col("line") == "RES")).alias("n_res"), F.count_if(F.col("head") & (F.col("line") == "LIN")).alias("n_lin"),
        F.bool_or(~F.col("head") & bad).alias("bad"),
    )
    res = structure_residues(docs, key, text).select(key, F.col("residue").alias("r")).distinct()
    lin = structure_links(docs, key, text)
    lost = lambda c: lin.join(res, (lin[key] == res[key]) & (lin[c] == F.col("r")), "left_anti").select(key).distinct().withColumn(f"no_{c}", F.lit(True))
    back = lin.filter("parent >= child").select(key).distinct().withColumn("backwards", F.lit(True))
    rows = shape.join(lost("parent"), key, "left").join(lost("child"), key, "left").join(back, key, "left")
    reason = F.expr("case when first_head = 'LIN' then 'LIN before RES' when n_res > 1 or n_lin > 1 then 'repeated section' when bad then 'bad line' when no_parent then 'parent missing' when no_child then 'child missing' when backwards then 'backwards link' end")
    return rows.select(key, reason.alias("reason")).filter("reason is not null")


def structure_text(residues: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, text) from (key, residue, line) and (key, link, line) rows, residues first, in order."""
    one = lambda df, n: df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, "line"))), lambda x: x["line"]), "\n").alias(n))
    rows = one(residues, "residue").join(one(links, "link"), key, "left")
    return rows.select(key, F.concat(F.lit("RES\n"), "residue", F.when(F.col("link").isNotNull(), F.concat(F.lit("\nLIN\n"), "link")).otherwise("")).alias("text"))
