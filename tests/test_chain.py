import pytest
from pyspark.sql import functions as F

from sugarmill.operators import chain
from sugarmill.plans import chain as plans

SYMBOLS = "image_id long, source string, mono_idx long, symbol string, x int, y int, w int, h int, imwidth int, imheight int, cen_x int, cen_y int"
DET = "image_id long, det_id long, class_id int, x int, y int, w int, h int, conf double"


def row(image, k, symbol, x):
    return (image, "box", k, symbol, x, 100, 40, 40, 640, 400, x + 20, 120)


def test_unknown_pipeline_names_the_known(spark):
    with pytest.raises(ValueError, match="contour-root"):
        plans.annotated(spark, "/nowhere", ["box-vote", "other"])


def test_a_chain_of_three_and_lone_symbols(spark):
    rows = [row(1, 0, "Fuc", 400), row(1, 1, "GlcNAc", 20), row(1, 2, "NeuAc", 210), row(2, 0, "Man", 20), row(3, 0, "Gal", 20), row(3, 1, "Gal", 500)]
    s = spark.createDataFrame(rows, SYMBOLS)
    con = spark.createDataFrame([((1, "box"), 0, 395, 120), ((1, "box"), 1, 205, 120)], "image_id struct<image_id:long,source:string>, contour_idx long, cx int, cy int")
    det = spark.createDataFrame([(1, 9, 0, 205, 98, 50, 44, 0.9), (1, 8, 5, 0, 0, 9, 9, 0.4)], DET)
    none = lambda t: (t.select("text", F.lit("G1").alias("accession")), t.select("text", F.lit("T1").alias("accession")).limit(0))
    got = {(r.image_id, r.pipeline): r for r in chain.annotate(s, con, det, none).collect()}
    assert got[1, "box-vote"].structure == "NeuAc(Fuc(),GlcNAc())" and got[1, "box-root"].structure == "NeuAc(Fuc(),GlcNAc())"
    assert got[1, "box-orientation"].structure == "GlcNAc(NeuAc(Fuc()))"
    assert {r.structure for k, r in got.items() if k[0] != 1} == {None}
    assert got[2, "box-vote"].linktype == "composition" and got[1, "box-vote"].uri == "?focus=G1" and len(got) == 9


def test_empty(spark):
    con = spark.createDataFrame([], "image_id struct<image_id:long,source:string>, contour_idx long, cx int, cy int")
    found = chain.annotate(spark.createDataFrame([], SYMBOLS), con, spark.createDataFrame([], DET), lambda t: (t.select("text", F.lit("G").alias("accession")),) * 2)
    assert found.count() == 0
