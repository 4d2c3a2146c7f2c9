"""Equality of glycans whose residues may have several possible parents, by colour refinement.

A residue's colour is its label; in each round it becomes a digest of itself and of the sorted colours of parents and children with the
labels of the links. After as many rounds as a glycan has residues colours change no more. Glycans that are equal have equal
sets of coloured links. The other way round that holds where every residue has a colour of its own, as links then map one to one, and
where links form a tree. For the rest, each residue of the smallest shared colour is singled out in turn and refined again; where
that gives all residues their own colour, the least of the outcomes decides. What stays is reported as undecided.

A glycan's residues and links are bounded by its notation, so all rounds are one fold over arrays after one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.functions.lineage import cut


def refined(colours: Column, links: Column) -> Column:
    """Colours after as many rounds as there are residues; links are (p, c, label) with places in the list of colours."""

    def side(now: Column, i: Column, own: str, other: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.filter(links, lambda e: e[own] == i), lambda e: F.concat(e["label"], F.lit("="), F.get(now, e[other])))), ",")

    def step(now: Column, _: Column) -> Column:
        return F.transform(now, lambda x, i: F.md5(F.concat(x, F.lit("<"), side(now, i, "c", "p"), F.lit(">"), side(now, i, "p", "c"))))

    return F.aggregate(F.sequence(F.lit(1), F.size(colours)), colours, step)


def certificate(colours: Column, links: Column) -> Column:
    """A digest of the coloured residues and links."""
    lines = F.transform(links, lambda e: F.concat(F.get(colours, e["p"]), e["label"], F.lit(">"), F.get(colours, e["c"])))
    return F.sha2(F.concat(F.array_join(F.array_sort(colours), ","), F.lit("#"), F.array_join(F.array_sort(lines), ",")), 256)


def graphs(nodes: DataFrame, links: DataFrame, key: str = "glycan_id") -> DataFrame:
    """(key, nodes, colours, links): each glycan as arrays, links by places of their ends. Links with an end that is no node are left out,
    repeated nodes and links count once, null labels are a label of their own."""
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("?"))
    n = nodes.filter(F.col(key).isNotNull() & F.col("node").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("node", label.alias("label")))).alias("all"))
    e = links.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("parent", "child", label.alias("label")))).alias("lines"))
    rows = n.join(e, key, "left").withColumn("nodes", F.transform("all", lambda x: x["node"]))
    at = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    placed = F.transform(F.coalesce("lines", F.array().cast(e.schema["lines"].dataType)), lambda x: F.struct(at(x["parent"]).alias("p"), at(x["child"]).alias("c"), x["label"].alias("label")))
    return rows.select(key, "nodes", F.transform("all", lambda x: F.md5(x["label"])).alias("colours"), F.filter(placed, lambda x: (x["p"] >= 0) & (x["c"] >= 0)).alias("links"))


def equal_candidates(nodes: DataFrame, links: DataFrame, key: str = "glycan_id", single_out: bool = True) -> DataFrame:
    """(key, class_id, n_nodes, n_colours, decided): glycans that may be equal share a class, named after its least key; they are equal
    where ``decided``. ``nodes`` is (key, node, label), ``links`` is (key, parent, child, label). With ``single_out`` glycans that refinement
    leaves open are refined again with one residue singled out."""
    # cut, as an optimiser that puts one expression into another would refine anew for each link
    rows = cut(graphs(nodes, links, key).withColumn("final", refined(F.col("colours"), F.col("links"))))
    n, kinds = F.size("nodes"), F.size(F.array_distinct("final"))
    heads = F.size(F.array_distinct(F.transform("links", lambda e: e["c"])))
    tree = (F.size("links") == n - 1) & (heads == n - 1)
    rows = rows.select(key, n.alias("n_nodes"), kinds.alias("n_colours"), "final", "links", ((kinds == n) | tree).alias("plain"), certificate(F.col("final"), F.col("links")).alias("certificate"))
    if not single_out:
        found = rows.withColumn("decided", F.col("plain"))
    else:
        counts = F.transform(F.array_distinct("final"), lambda c: F.struct(F.size(F.filter("final", lambda x: x == c)).alias("n"), c.alias("c")))
        shared = F.array_min(F.filter(counts, lambda x: x["n"] > 1))["c"]
        open_ = rows.filter("not plain").withColumn("shared", shared)
        places = F.filter(F.sequence(F.lit(0), F.size("final") - 1), lambda i: F.get("final", i) == F.col("shared"))
        marked = lambda i: F.transform("final", lambda x, j: F.when(i == j, F.md5(F.concat(x, F.lit("!")))).otherwise(x))
        tried = cut(open_.withColumn("places", places).withColumn("tried", F.transform("places", lambda i: refined(marked(i), F.col("links")))))
        tried = tried.withColumn("decided", F.forall("tried", lambda c: F.size(F.array_distinct(c)) == F.size(c)))
        least = F.array_min(F.transform("tried", lambda c: certificate(c, F.col("links"))))
        tried = tried.withColumn("certificate", F.when(F.col("decided"), F.concat("certificate", least)).otherwise(F.col("certificate")))
        columns = [key, "n_nodes", "n_colours", "certificate", "decided"]
        found = rows.filter("plain").withColumn("decided", F.lit(True)).select(*columns).unionByName(tried.select(*columns))
    ids = found.groupBy("certificate").agg(F.min(key).alias("class_id"))
    return found.join(ids, "certificate").select(key, "class_id", "n_nodes", "n_colours", "decided")
