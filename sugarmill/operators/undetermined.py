"""Structure text with undetermined parents: after the residues and links, a UND section holds subtrees with the residues that may be their parents.

Each subtree begins with ``UND<k>:<share>:<share>``, states ``ParentIDs:<id>|<id>`` and ``SubtreeLinkageID1:<link without ids>``, and has residue and link
sections of its own. What a line belongs to is carried down by windows over the lines of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.operators.textforms import LINK, RESIDUE

BEGIN = r"^UND(\d+):"
PARENTS = r"^ParentIDs:(\d+(?:\|\d+)*)$"
LINKAGE = r"^SubtreeLinkageID\d+:([a-z])\((-?\d+)\+(-?\d+)\)([a-z])$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, head, section, und): non-empty lines with their section and, from the UND section on, the subtree's number."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    start, head = F.col("line").rlike(BEGIN), F.col("line").rlike("^[A-Z]{3}$")
    so_far = Window.partitionBy(key).orderBy("at")
    section = F.last(F.when(start, "UND").when(head, F.col("line")), ignorenulls=True).over(so_far)
    und = F.last(F.when(start, F.regexp_extract("line", BEGIN, 1).try_cast("int")), ignorenulls=True).over(so_far)
    return rows.select(key, "at", "line", head.alias("head"), section.alias("section"), und.alias("und"), start.alias("start"))


def subtrees(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, und, parents, parent_type, parent_pos, child_pos, child_type, root): what each subtree states; null where it does not."""
    rows = lines(docs, key, text).filter("und is not null")
    part = lambda k: F.regexp_extract("line", LINKAGE, k)
    whole = lambda k: F.nullif(part(k).try_cast("int"), F.lit(-1))
    here = lambda pattern: (F.col("section") == "UND") & F.col("line").rlike(pattern)
    link = F.first(F.when(here(LINKAGE), F.struct(part(1).alias("parent_type"), whole(2).alias("parent_pos"), whole(3).alias("child_pos"), part(4).alias("child_type"))), ignorenulls=True)
    parents = F.first(F.when(here(PARENTS), F.transform(F.split(F.regexp_extract("line", PARENTS, 1), r"\|"), lambda x: x.try_cast("int"))), ignorenulls=True)
    root = F.min(F.when((F.col("section") == "RES") & F.col("line").rlike(RESIDUE), F.struct("at", F.regexp_extract("line", RESIDUE, 1).try_cast("int").alias("residue"))))["residue"]
    return rows.groupBy(key, "und").agg(parents.alias("parents"), link.alias("link"), root.alias("root")).select(key, "und", "parents", "link.*", "root")


def undetermined_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, und, parent, parent_type, parent_pos, child_pos, child, child_type): a row for each possible parent of a subtree; subtrees that
    lack parents, linkage or residues have none."""
    rows = subtrees(docs, key, text).filter("parent_type is not null and root is not null")
    return rows.select(key, "und", F.explode(F.array_distinct("parents")).alias("parent"), "parent_type", "parent_pos", "child_pos", F.col("root").alias("child"), "child_type")


def rejects(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) of texts that cannot be read: the first that holds of unsupported section, LIN before RES, UND before RES or LIN, repeated
    section, bad line, incomplete subtree, parent missing, unconnected count.

    Residues without a parent, possible ones included, are one, or all (a composition); only kind ``b`` counts.
    """
    rows = lines(docs, key, text)
    main = F.col("und").isNull() & F.col("head")
    first = lambda name: F.min(F.when(main & (F.col("line") == name), F.col("at")))
    n = lambda name: F.count_if(main & (F.col("line") == name))
    good = F.when(F.col("head") | F.col("start"), True).when(F.col("section") == "RES", F.col("line").rlike(RESIDUE)).when(F.col("section") == "LIN", F.col("line").rlike(LINK)).when((F.col("section") == "UND") & F.col("und").isNotNull(), F.col("line").rlike(PARENTS) | F.col("line").rlike(LINKAGE)).otherwise(False)
    shape = rows.groupBy(key).agg(
        F.bool_or(F.col("head") & ~F.col("line").isin("RES", "LIN", "UND")).alias("odd"), first("RES").alias("res"), first("LIN").alias("lin"), first("UND").alias("und"), ((n("RES") > 1) | (n("LIN") > 1) | (n("UND") > 1)).alias("again"), F.bool_or(~good).alias("bad"),
    )
    trees = subtrees(docs, key, text)
    open_ = trees.groupBy(key).agg(F.bool_or(F.col("parents").isNull() | F.col("parent_type").isNull() | F.col("root").isNull()).alias("open"))
    own = rows.filter(~F.col("head") & (F.col("section") == "RES") & F.col("line").rlike(RESIDUE)).select(key, F.regexp_extract("line", RESIDUE, 1).try_cast("int").alias("residue"), F.regexp_extract("line", RESIDUE, 2).alias("kind"))
    there = rows.filter(~F.col("head") & (F.col("section") == "LIN") & F.col("line").rlike(LINK)).select(key, F.regexp_extract("line", LINK, 2).try_cast("int").alias("parent"), F.regexp_extract("line", LINK, 6).try_cast("int").alias("child"))
    ends = there.unionByName(undetermined_links(docs, key, text).select(key, "parent", "child"))
    lost = ends.select(key, F.explode(F.array("parent", "child")).alias("residue")).join(own.select(key, "residue"), [key, "residue"], "left_anti").select(key).distinct().withColumn("lost", F.lit(True))
    kids = ends.select(key, F.col("child").alias("residue")).distinct().withColumn("has", F.lit(1))
    heads = own.filter("kind = 'b'").join(kids, [key, "residue"], "left").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("heads"))
    all_ = shape.join(open_, key, "left").join(lost, key, "left").join(heads, key, "left")
    reason = (
        F.when(F.col("odd"), "unsupported section").when(F.col("lin") < F.coalesce("res", F.lit(2**30)), "LIN before RES").when(F.col("und") < F.greatest(F.coalesce("res", F.lit(2**30)), F.coalesce("lin", F.lit(2**30))), "UND before RES or LIN")
        .when(F.col("again"), "repeated section").when(F.col("bad"), "bad line").when(F.col("open"), "incomplete subtree").when(F.col("lost"), "parent missing").when(~F.coalesce((F.col("heads") == 1) | (F.col("heads") == F.col("n")), F.lit(False)), "unconnected count")
    )
    return all_.select(key, reason.alias("reason")).filter("reason is not null")


def with_subtrees(texts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, text): ``texts`` with a UND section for the (key, und, parents, linkage, residues, links) rows of its subtrees; residues and links as lines."""
    one = F.concat(
        F.lit("UND"), F.col("und").cast("string"), F.lit(":100.0:100.0\nParentIDs:"), F.array_join(F.array_sort("parents").cast("array<string>"), "|"), F.lit("\nSubtreeLinkageID1:"), "linkage", F.lit("\nRES\n"), F.array_join("residues", "\n"),
        F.when(F.size("links") > 0, F.concat(F.lit("\nLIN\n"), F.array_join("links", "\n"))).otherwise(""),
    )
    some = found.select(key, F.struct("und", one.alias("one")).alias("s")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["one"]), "\n").alias("tail"))
    return texts.join(some, key, "left").select(key, F.concat("text", F.coalesce(F.concat(F.lit("\nUND\n"), "tail"), F.lit(""))).alias("text"))
