"""From detections to looked-up structures, and placing them on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.operators import composition, detections

#: Named pipelines: where symbols come from, and how the root is chosen.
PIPELINES = {
    "box-vote": ("box", "vote"), "box-orientation": ("box", "orientation"), "box-root": ("box", "root"),
    "contour-vote": ("contour", "vote"), "contour-orientation": ("contour", "orientation"), "contour-root": ("contour", "root"),
}


def looked_up(structures: DataFrame, exact: DataFrame, equivalent: DataFrame) -> DataFrame:
    """Structures (key, text) with accession and source: the exact text first, then its equivalents; the smallest of several."""
    first = lambda t: t.groupBy("text").agg(F.min("accession").alias("accession"))
    a = first(exact).withColumnRenamed("accession", "exact_accession")
    b = first(equivalent).withColumnRenamed("accession", "equivalent_accession")
    rows = structures.join(a, "text", "left").join(b, "text", "left")
    source = F.when(F.col("exact_accession").isNotNull(), "exact").when(F.col("equivalent_accession").isNotNull(), "equivalent")
    return rows.withColumns({"accession": F.coalesce("exact_accession", "equivalent_accession"), "source": source}).drop("exact_accession", "equivalent_accession")


def result_uri(accession: Column, composition_text: Column) -> tuple[Column, Column]:
    """The link and its type: a registered structure, a submitted one, or a composition query."""
    uri = F.when(accession.startswith("G"), F.concat(F.lit("?focus="), accession)).when(accession.isNotNull(), F.concat(F.lit("?ondemandtaskid="), accession)).otherwise(F.concat(F.lit("?composition="), composition_text))
    kind = F.when(accession.startswith("G"), "structure").when(accession.isNotNull(), "task").otherwise("composition")
    return uri, kind


def annotate(det: DataFrame, symbols: DataFrame, structures: DataFrame, exact: DataFrame, equivalent: DataFrame, threshold: float = 0.3, pipeline: str = "box-root", key: tuple[str, ...] = ("image_id", "det_id")) -> DataFrame:
    """(image_id, symbols, composition, structure, accession, source, uri, linktype) of every image with a kept symbol.

    Detections are thinned; a contour pipeline takes those that are most likely outlines, twice the threshold. A
    structure (image_id, text, n) counts only if it has as many nodes as symbols were kept. A kept box has the symbols of all
    detections with its ``key``.
    """
    if pipeline not in PIPELINES:
        raise ValueError(f"no pipeline {pipeline!r}; there are {', '.join(PIPELINES)}")
    source, _ = PIPELINES[pipeline]
    kept = detections.non_max_suppression(det, threshold * (2 if source == "contour" else 1))
    named = kept.join(det.select(*key, "class_id"), list(key)).join(symbols, "class_id")
    counts = named.groupBy("image_id", "symbol").agg(F.count("*").alias("n"))
    rows = composition.text(counts, "image_id").join(counts.groupBy("image_id").agg(F.sum("n").alias("symbols")), "image_id")
    gate = structures.select("image_id", F.col("text").alias("t"), F.col("n").alias("nodes"))
    rows = rows.join(gate, "image_id", "left").withColumn("text", F.when(F.col("nodes") == F.col("symbols"), F.col("t")))
    found = looked_up(rows, exact, equivalent)
    uri, kind = result_uri(F.col("accession"), F.col("composition"))
    return found.select("image_id", "symbols", "composition", F.col("text").alias("structure"), "accession", "source", uri.alias("uri"), kind.alias("linktype"))


def figure_filter(figures: DataFrame, least: float = 60.0) -> DataFrame:
    """Figures wider and higher than ``least``, with the vertical axis turned from the page's foot to its head."""
    big = figures.filter((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))
    return big.withColumns({"top": F.col("page_h") - F.col("y1"), "bottom": F.col("page_h") - F.col("y0")})


def result_ids(figures: DataFrame) -> DataFrame:
    """``page-figure-count`` with pages from 0 and a running count in the document."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("page", "figure"))
    return figures.withColumn("result_id", F.concat_ws("-", (F.col("page") - 1).cast("string"), F.col("figure").cast("string"), n.cast("string")))


def on_page(low: str, high: str, share: Column) -> Column:
    """A share of a figure's side as a page coordinate."""
    return F.col(low) + share * (F.col(high) - F.col(low))


RESULTS = "image_id long, name string, glycans array<struct<det_id: long, class_id: int, conf: double, bbox: array<int>>>"


def results(detections: DataFrame) -> DataFrame:
    """``RESULTS``: a nested record for each image, detections by id. An image bounds its detections."""
    one = F.struct("det_id", "class_id", "conf", F.array("x", "y", "w", "h").alias("bbox"))
    return detections.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("glycans")).select("image_id", F.concat(F.lit("image"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "glycans")


def write_results(detections: DataFrame, path: str) -> None:
    """Writes the records as JSON lines; what is in ``path`` is replaced."""
    results(detections).write.mode("overwrite").json(path)


def read_results(spark, path: str) -> DataFrame:
    """The records of ``write_results``; lines that are no record are left out."""
    return spark.read.schema(RESULTS).option("mode", "DROPMALFORMED").json(path)
