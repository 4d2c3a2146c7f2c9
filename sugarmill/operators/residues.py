"""Residues compared on all their fields, where null is unknown: equality, two kinds of compatibility, completeness.

A residue has an anomer, a superclass, ring ends, lists of configurations and stems whose elements may be unknown, modifications in order
and substituents. Fields that are known on both sides must agree. What is known is a pattern, a bit for each field; for each pair of
patterns that occur, the fields that both know are an equi-join key, so no pair of residues is formed that does not match. There are
at most 2 ** 10 patterns, whatever the input; residues that are alike are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a list of configurations or stems.
LISTED = 3
SCALARS = ("anomer", "superclass", "ring_start", "ring_end")
FIELDS = [*SCALARS, *(f"{c}{k}" for c in ("config", "stem") for k in range(LISTED))]
#: Fields that do not show in a figure; the anomer of a root does not either.
HIDDEN = {"ring_start", "ring_end", *(f"config{k}" for k in range(LISTED))}


def spread(rows: DataFrame) -> DataFrame:
    """The rows with a text for each of ``FIELDS`` (null unknown), ``n_stems`` and ``n_configs``, ``mods`` and ``substituents`` as given."""
    one = lambda c, k: F.get(F.col(c), F.lit(k)).cast("string")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    out = rows.withColumns({"n_stems": size("stems"), "n_configs": size("configs"), **{f"{a}{k}": one(b, k) for a, b in (("config", "configs"), ("stem", "stems")) for k in range(LISTED)}})
    long = (F.col("n_stems") > LISTED) | (F.col("n_configs") > LISTED)
    return out.withColumns({"n_stems": F.when(long, F.raise_error(F.lit(f"more than {LISTED} stems"))).otherwise(F.col("n_stems")), **{c: F.col(c).cast("string") for c in SCALARS}})


def classes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(class members: key, id; distinct residues: id and all fields). Residues that agree in every field, unknown ones included, and whose
    substituents are the same in any order, are one class; ``id`` is its smallest key."""
    flat = spread(rows).withColumn("bag", F.array_sort(F.coalesce("substituents", F.array().cast("array<string>"))))
    same = [*FIELDS, "n_stems", "n_configs", "mods", "bag", "substituents"]
    ids = flat.groupBy(*same).agg(F.min(key).alias("own"))
    least = ids.groupBy(*(c for c in same if c != "substituents")).agg(F.min("own").alias("id"), F.array_sort(F.collect_set("substituents")).alias("orders"))
    on = [flat[c].eqNullSafe(least[c]) for c in same if c != "substituents"]
    return flat.join(least, on).select(flat[key], least["id"]), least


def pattern(fields: list[str]) -> Column:
    """Which of ``fields`` are known, a bit each."""
    return sum((F.when(F.col(c).isNotNull(), 1 << k).otherwise(0) for k, c in enumerate(fields)), F.lit(0))


def known_key(fields: list[str], mask: Column) -> Column:
    """The values of the fields in a mask."""
    return F.array(*(F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.col(c)) for k, c in enumerate(fields)))


def patterns(rows: DataFrame) -> Column:
    """The patterns that occur, as a literal: at most 2 ** 10."""
    return F.array(*(F.lit(r["pattern"]) for r in rows.select("pattern").distinct().collect()))


def compatible(least: DataFrame) -> DataFrame:
    """(a, b): pairs a <= b of distinct residues that may be the same one: what both know agrees, as do the lengths of the lists, the
    modifications and the kinds of their substituents in order (``pos/link/kind`` texts)."""
    rows = least.select("*", F.explode("orders").alias("substituents")).withColumn("kinds", F.transform("substituents", lambda s: F.substring_index(s, "/", -1))).withColumn("pattern", pattern(FIELDS))
    there = patterns(rows)
    fixed = ["n_stems", "n_configs", "mods", "kinds"]
    both = F.col("pattern").bitwiseAND(F.col("other"))
    each = rows.select("id", "pattern", *fixed, *FIELDS, F.explode(there).alias("other")).withColumn("known", known_key(FIELDS, both))
    a = each.select(F.col("id").alias("a"), F.col("pattern").alias("p"), F.col("other").alias("q"), F.struct("known", *fixed).alias("key"))
    b = each.select(F.col("id").alias("b"), F.col("other").alias("p"), F.col("pattern").alias("q"), F.struct("known", *fixed).alias("key"))
    return a.join(b, ["p", "q", "key"]).filter("a <= b").select("a", "b").distinct()


def compatible_with(least: DataFrame, root: bool = False, visible_only: bool = False) -> DataFrame:
    """(a, b): pairs of distinct residues of which ``a`` has all that ``b`` knows, lists of one length (configurations too unless
    ``visible_only``), the same modifications, and the same substituents in any order with links and positions.

    ``visible_only`` leaves out what a figure does not show: configurations and ring ends and, for a ``root``, the anomer.
    """
    fields = [c for c in FIELDS if not (visible_only and (c in HIDDEN or root and c == "anomer"))]
    fixed = ["n_stems", "mods", "bag"] + ([] if visible_only else ["n_configs"])
    rows = least.withColumn("pattern", pattern(fields))
    asked = F.filter(patterns(rows), lambda q: q.bitwiseAND(F.col("pattern")) == q)
    a = rows.select(F.col("id").alias("a"), *fixed, *fields, F.explode(asked).alias("q")).select("a", "q", F.struct(known_key(fields, F.col("q")).alias("known"), *fixed).alias("key"))
    b = rows.select(F.col("id").alias("b"), F.col("pattern").alias("q"), F.struct(known_key(fields, F.col("pattern")).alias("known"), *fixed).alias("key"))
    return a.join(b, ["q", "key"]).select("a", "b")


def determined(rows: DataFrame) -> Column:
    """Whether all fields, all elements of the lists and the positions of all modifications (``pos:mod`` texts) are known."""
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    known = [F.col(c).isNotNull() for c in SCALARS] + [whole("configs"), whole("stems"), ~F.exists("mods", lambda m: m.startswith("?"))]
    out = F.lit(True)
    for k in known:
        out = out & k
    return F.coalesce(out, F.lit(False))


def predicates(rows: DataFrame) -> DataFrame:
    """Residues with ``noring`` (both ends of the ring known as 0) and a row for each kind of modification with its number; kind is null and n 0 where there is none."""
    kinds = rows.withColumns({"kinds": F.transform(F.coalesce("mods", F.expr("cast(array() as array<string>)")), lambda m: F.substring_index(m, ":", -1)), "noring": F.coalesce((F.col("ring_start") == 0) & (F.col("ring_end") == 0), F.lit(False))})
    each = kinds.select("residue", "noring", "kinds", F.explode_outer(F.array_distinct("kinds")).alias("kind"))
    return each.select("residue", "noring", "kind", F.size(F.filter("kinds", lambda k: k == F.col("kind"))).cast("long").alias("n"))


def listing(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(glycan_id, node, parents, children): what a residue is linked to, by number; ``->`` is a settled link, ``~>`` one of several possible.

    ``links`` is (glycan_id, parent, child, settled). Residues without links have empty lists.
    """
    ends = F.array(F.struct(F.col("parent").alias("node"), F.lit(True).alias("down"), F.col("child").alias("other"), "settled"), F.struct(F.col("child").alias("node"), F.lit(False).alias("down"), F.col("parent").alias("other"), "settled"))
    each = links.select("glycan_id", F.explode(ends).alias("e")).select("glycan_id", "e.*")
    named = lambda down: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("down") == down, F.struct("other", "settled")))), lambda x: F.concat(F.when(x["settled"], "->").otherwise("~>"), x["other"].cast("string"))), ",")
    found = each.groupBy("glycan_id", "node").agg(named(F.lit(False)).alias("parents"), named(F.lit(True)).alias("children"))
    return nodes.select("glycan_id", "node").join(found, ["glycan_id", "node"], "left").fillna("", ["parents", "children"])
