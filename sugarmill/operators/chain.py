"""The whole way from an image's symbols to a looked-up structure: links, root, tree, text, accession, link.

Symbols are rows (image_id, source, mono_idx, symbol, x, y, w, h, imwidth, imheight, cen_x, cen_y): ``source`` tells how they
were found. All sources and root methods go through one plan, keyed by image, source and method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.functions.lineage import cut
from sugarmill.operators import annotation, boxes, composition, detections, linking, overlap, structures

METHODS = ("vote", "orientation", "root")


def numbered(found: DataFrame, source: str, *order: str | Column) -> DataFrame:
    """Symbols of one source, numbered within their image from 0 in an order, with their centres."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(*order)) - 1
    out = boxes.centres(found).withColumn("mono_idx", n.cast("long"))
    return out.select("image_id", F.lit(source).alias("source"), "mono_idx", "symbol", "x", "y", "w", "h", "imwidth", "imheight", "cen_x", "cen_y")


def keyed(symbols: DataFrame) -> DataFrame:
    """Symbols with image and source as one key, under which linking treats the sources of an image apart."""
    return symbols.withColumn("image_id", F.struct("image_id", "source")).drop("source")


def roots(symbols: DataFrame, links: DataFrame, det: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(image_id, method, node) with keyed images: by the vote of the links, by the best detection's class as an orientation, or the
    symbol under the best detection of class 0."""
    m = keyed(symbols)
    found = []
    if "vote" in methods:
        vote = linking.root_by_orientation(m.join(linking.orientation_vote(links, m), "image_id", "left"))
        found.append(vote.select("image_id", F.lit("vote").alias("method"), F.col("mono_idx").alias("node")))
    if "orientation" in methods:
        best = detections.first_by(det, ["image_id"], [F.desc("conf"), "det_id"]).select("image_id", (F.col("class_id") % 4).alias("orientation"))
        turned = linking.root_by_orientation(keyed(symbols.join(best, "image_id", "left")))
        found.append(turned.select("image_id", F.lit("orientation").alias("method"), F.col("mono_idx").alias("node")))
    if "root" in methods:
        top = detections.first_by(det.filter("class_id = 0"), ["image_id"], [F.desc("conf"), "det_id"])
        marks = symbols.withColumns({"box_id": F.struct("source", "mono_idx"), "class_id": F.lit(0)})
        near = overlap.paired(marks, top).withColumn("good", overlap.verdict(*(F.lit(x) for x in overlap.PROFILES["root"])))
        first = detections.first_by(near, ["image_id", "t_box_id.source"], [F.desc("inter"), "t_box_id"]).filter("good")
        found.append(first.select(F.struct("image_id", F.col("t_box_id.source").alias("source")).alias("image_id"), F.lit("root").alias("method"), F.col("t_box_id.mono_idx").alias("node")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def trees(symbols: DataFrame, contours: DataFrame, det: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(glycan_id, node, parent, depth, symbol) of the images whose links make one tree; glycan_id is (image_id, source, method)."""
    m = cut(keyed(symbols))
    links = cut(linking.ray_links(m, contours, linking.mean_distance(m)))
    several = F.explode(F.array(*map(F.lit, methods))).alias("method")
    gid = F.struct(F.col("image_id.image_id").alias("image_id"), F.col("image_id.source").alias("source"), "method").alias("glycan_id")
    nodes = m.select("image_id", "mono_idx", "symbol", several).select(gid, F.col("mono_idx").alias("node"), "symbol")
    lines = links.select("*", several).select(gid, "a", "b")
    walked = cut(structures.rooted(lines, roots(symbols, links, det, methods).select(gid, "node")))  # counted and joined
    whole = structures.tree_checks(nodes, lines, walked).filter("reason is null").select("glycan_id")
    return cut(walked.join(whole, "glycan_id", "left_semi").join(nodes, ["glycan_id", "node"]))


def structure_keys(rows: DataFrame) -> DataFrame:
    """(glycan_id, text): the canonical text of each tree."""
    texts = structures.canonical(rows, "symbol")
    return texts.join(rows.filter("parent is null").select("glycan_id", "node"), ["glycan_id", "node"]).select("glycan_id", "text")


def residue_order(rows: DataFrame) -> DataFrame:
    """Trees with ``residue``, a number from 1 in a walk from the root: children by their subtree's text, then number."""
    named = rows.join(structures.canonical(rows, "symbol"), ["glycan_id", "node"])
    places = structures.preorder(named, "text", orphans=False).select("glycan_id", "node", (F.col("place") + 1).alias("residue"))
    return rows.join(places, ["glycan_id", "node"])


def linked_residues(rows: DataFrame) -> DataFrame:
    """Ordered residues with their parent's number and the place that links to it: 2 of NeuAc, else 1."""
    n = residue_order(rows)
    up = n.select("glycan_id", F.col("node").alias("parent"), F.col("residue").alias("parent_residue"))
    return n.join(up, ["glycan_id", "parent"], "left").withColumn("child_pos", F.when(F.col("symbol") == "NeuAc", 2).otherwise(1))


def annotate(symbols: DataFrame, contours: DataFrame, det: DataFrame, registered, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(image_id, pipeline, symbols, composition, structure, accession, source, uri, linktype): a row for each image, source and method.

    ``registered`` maps the found (glycan_id, text) to exact and equivalent (text, accession) tables. A tree holds every symbol of
    its image, so there is nothing to gate behind it. Images without symbols of a source have no row for it.
    """
    texts = cut(structure_keys(trees(symbols, contours, det, methods)))
    exact, equivalent = registered(texts)
    k = keyed(symbols)
    counts = k.groupBy("image_id", "symbol").agg(F.count("*").alias("n"))
    rows = composition.text(counts, "image_id").join(counts.groupBy("image_id").agg(F.sum("n").alias("symbols")), "image_id")
    gid = F.struct(F.col("image_id.image_id").alias("image_id"), F.col("image_id.source").alias("source"), "method").alias("glycan_id")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method")).select(gid, "symbols", "composition")
    found = annotation.looked_up(rows.join(texts, "glycan_id", "left"), exact, equivalent)
    uri, kind = annotation.result_uri(F.col("accession"), F.col("composition"))
    return found.select("glycan_id.image_id", pipeline_name().alias("pipeline"), "symbols", "composition", F.col("text").alias("structure"), "accession", "source", uri.alias("uri"), kind.alias("linktype"))


def pipeline_name() -> Column:
    """``source-method`` of a glycan_id."""
    return F.concat_ws("-", "glycan_id.source", "glycan_id.method")
