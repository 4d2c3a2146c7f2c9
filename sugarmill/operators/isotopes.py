"""Isotope clusters of formulas of any elements.

The ways to put heavy isotopes into the atoms of an element depend only on the element and its number of atoms, so they are made once for
each such pair. A formula's cluster is the convolution of its elements' ways over the sums of their offsets, one fold over the
elements of a distinct formula; formulas repeat, so each is folded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OFFSETS, LEAST = 5, 1e-5
WAY = "offset int, heavy long, p double, mass double"


def chosen(n: Column, k: Column) -> Column:
    """n (n - 1) .. (n - k + 1) / k!, as a double; 1 for k = 0."""
    return F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - i + 1).cast("double") / i))


def ways(atoms: DataFrame, isotopes: DataFrame, offsets: int = OFFSETS) -> DataFrame:
    """(element, n, offset, p, mass): for distinct (element, n) rows, the ways to take isotopes of at most ``offsets`` more neutrons in all,
    with probability and mass of the atoms. ``isotopes`` is (element, neutrons, mass, share), neutrons above the lightest.

    An isotope without a share is never taken; elements without isotopes give no rows.
    """
    light = isotopes.filter("neutrons = 0").select("element", F.col("mass").alias("m0"), F.col("share").alias("p0"))
    rows = atoms.filter("n >= 0").join(F.broadcast(light), "element").select("element", "n", "m0", "p0", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("heavy"), F.lit(1.0).alias("p"), F.lit(0.0).alias("more"))
    heavy = [r["neutrons"] for r in isotopes.filter(F.col("neutrons").between(1, offsets)).select("neutrons").distinct().orderBy("neutrons").collect()]  # at most as many as offsets
    for k in heavy:
        one = F.broadcast(isotopes.filter((F.col("neutrons") == k) & (F.col("share") > 0)).select("element", F.col("mass").alias("m"), F.col("share").alias("s")))
        most = F.when(F.col("s").isNull(), 0).otherwise(F.least(F.floor((offsets - F.col("offset")) / k), F.col("n") - F.col("heavy")))
        rows = rows.join(one, "element", "left").withColumn("c", F.explode(F.sequence(F.lit(0), most.cast("int"))))
        # on its own, as names in a lambda would mean the columns that the select makes
        rows = rows.withColumn("times", chosen(F.col("n") - F.col("heavy"), F.col("c")))
        p = F.col("p") * F.col("times") * F.when(F.col("c") == 0, 1.0).otherwise(F.pow("s", "c"))
        rows = rows.select("element", "n", "m0", "p0", (F.col("offset") + k * F.col("c")).alias("offset"), (F.col("heavy") + F.col("c")).alias("heavy"), p.alias("p"), (F.col("more") + F.when(F.col("c") == 0, 0.0).otherwise(F.col("c") * (F.col("m") - F.col("m0")))).alias("more"))
    rest = F.col("n") - F.col("heavy")
    return rows.select("element", "n", "offset", (F.col("p") * F.pow("p0", rest)).alias("p"), (F.col("n") * F.col("m0") + F.col("more")).alias("mass"))


def clusters(formulas: DataFrame, isotopes: DataFrame, key: str, offsets: int = OFFSETS, least: float = LEAST) -> DataFrame:
    """(key, peak, mass, shift, spacing, share, percent) from (key, element, n) rows.

    Combinations of isotopes of at most ``offsets`` neutrons and a probability above ``least`` count. A peak holds those whose mass is nearest to so
    many units above the lightest; ``mass`` is their mean, ``shift`` what it is above the lightest, ``spacing`` above the peak before (0 for the
    first), ``share`` of the whole cluster, ``percent`` of its highest peak. Elements without known isotopes make a formula fail
    to come out; one without atoms has none.
    """
    parts = formulas.filter("n > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("element", F.col("n").cast("long").alias("n")))).alias("formula"))
    distinct = parts.select("formula").distinct()
    atoms = distinct.select(F.explode("formula").alias("a")).select("a.element", "a.n").distinct()
    table = ways(atoms, isotopes, offsets).groupBy("element", "n").agg(F.collect_list(F.struct("offset", "p", "mass")).alias("ways"))
    each = distinct.select("formula", F.explode("formula").alias("a")).select("formula", "a.element", "a.n").join(table, ["element", "n"])
    folded = each.groupBy("formula").agg(F.collect_list("ways").alias("all")).filter(F.size("all") == F.size("formula"))
    none = F.array(F.struct(F.lit(0).alias("offset"), F.lit(1.0).alias("p"), F.lit(0.0).alias("mass")))

    def joined(acc: Column, more: Column) -> Column:
        with_all = F.transform(acc, lambda a: F.transform(F.filter(more, lambda w: a["offset"] + w["offset"] <= offsets), lambda w: F.struct((a["offset"] + w["offset"]).alias("offset"), (a["p"] * w["p"]).alias("p"), (a["mass"] + w["mass"]).alias("mass"))))
        return F.filter(F.flatten(with_all), lambda x: x["p"] > least)  # a product only gets smaller

    whole = folded.select("formula", F.aggregate("all", none, joined).alias("ways"))
    light = F.aggregate("all", F.lit(0.0), lambda acc, w: acc + F.array_min(F.transform(w, lambda x: x["mass"])))
    whole = whole.join(folded.select("formula", light.alias("light")), "formula")
    rows = whole.select("formula", "light", F.explode("ways").alias("w")).select("formula", "light", F.floor(F.col("w.mass") - F.col("light") + 0.5).cast("int").alias("peak"), "w.p", "w.mass")
    peaks = rows.groupBy("formula", "light", "peak").agg(F.sum("p").alias("p"), (F.sum(F.col("p") * F.col("mass")) / F.sum("p")).alias("mass"))
    own = Window.partitionBy("formula")
    before = F.lag("mass").over(own.orderBy("peak"))
    shaped = peaks.select("formula", "peak", "mass", (F.col("mass") - F.col("light")).alias("shift"), F.coalesce(F.col("mass") - before, F.lit(0.0)).alias("spacing"), (F.col("p") / F.sum("p").over(own)).alias("share"), (100 * F.col("p") / F.max("p").over(own)).alias("percent"))
    return parts.join(shaped, "formula").select(key, "peak", "mass", "shift", "spacing", "share", "percent")
