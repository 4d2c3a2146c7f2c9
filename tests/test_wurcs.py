import pytest
from pyspark.sql import functions as F

from sugarmill.operators import wurcs

HEAD = "[a2122h-1b_1-5][a1122h-1a_1-5]"
TEXTS = {
    1: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a4-b1_b3-c1",
    2: f"WURCS=2.0/2,3,3/{HEAD}/1-2-2/a4-b1_b3-c1_a1-c4",
    3: f"WURCS=2.0/2,4,3/{HEAD}/1-2-2-1/a4-b1_a6-b1_c3-d1",
    4: f"WURCS=2.0/2,3,2/{HEAD}/1-2-3/a4-b1_b3-c1",
    5: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a4-b1_b3-e1",
    6: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a4-b1_c1-a3|a6}}",
    7: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a4-b1_c1-a3|d6}}",
    8: f"WURCS=2.0/2,3,0/{HEAD}/1-2-2/",
    9: f"WURCS=2.0/1,1,0/[a2122h-1b_1-5]/1/",
    10: "",
    11: None,
    12: f"WURCS=2.0/2,2,2/{HEAD}/1-2/a4-b1_b1-a4",
    13: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a?-b?_b?-c?",
    14: f"WURCS=2.0/2,3,3/{HEAD}/1-2-2/a4-b1_b3-c1_a?|b?}}*OC",
    15: f"WURCS=2.0/2,2,2/{HEAD}/1-2/a1-b4_a4-b1",
    16: f"WURCS=2.0/2,3,2/{HEAD}/1-2-2/a?-c1_b?-c?",
}
REASONS = {2: "link count", 8: "link count", 3: "not connected", 4: "unit missing", 5: "residue missing", 6: "unsupported link", 7: "wrong order", 10: "bad form", 11: "bad form", 12: "wrong order", 14: "floating substituent", 15: "link count"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string").withColumn("glycan", F.lit("x")).cache()


def test_reasons(docs):
    assert {r["id"]: r["reason"] for r in wurcs.rejects(docs, "id", "text").collect()} == REASONS


def test_links(docs):
    rows = wurcs.links(docs, "id", "text").filter("id in (1, 13, 15)").collect()
    assert sorted((r["id"], r["link"], r["parent"], r["parent_pos"], r["child"], r["child_pos"]) for r in rows) == [
        (1, 1, 1, [4], 2, 1), (1, 2, 2, [3], 3, 1), (13, 1, 1, None, 2, None), (13, 2, 2, None, 3, None), (15, 1, 2, [4], 1, 1), (15, 2, 1, [4], 2, 1),
    ]


def test_empty(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert wurcs.residues(none, "id", "text").count() == wurcs.links(none, "id", "text").count() == wurcs.rejects(none, "id", "text").count() == 0
    assert wurcs.decoded(wurcs.residues(none, "id", "text")).count() == 0


def test_letters(spark):
    rows = spark.range(1, 2757).select("id", wurcs.lettered(F.col("id").cast("int")).alias("l")).select("id", "l", wurcs.number(F.col("l")).alias("n")).collect()
    assert all(r["n"] == r["id"] for r in rows)
    assert [r["l"] for r in rows if r["id"] in (1, 26, 27, 52, 53, 54, 105)] == ["a", "z", "A", "Z", "aa", "ab", "ba"]


@pytest.mark.parametrize(
    ("skeleton", "want"),
    [
        ("u2112m", (None, "HEX", ["gal"], ["d"], ["6d"])), ("u1221m", (None, "HEX", ["gal"], ["l"], ["6d"])), ("h2112h", ("uncyclized", "HEX", ["gal"], ["d"], ["1aldi"])), ("o222h", ("uncyclized", "PENT", ["rib"], ["d"], [])),
        ("hU122h", (None, "HEX", ["ara"], ["d"], ["2keto"])), ("A2112h", (None, "HEX", ["gal"], ["d"], ["1a", "1aldi"])), ("AUd112A", (None, "HEPT", ["lyx"], ["d"], ["1a", "2keto", "3d", "7a"])),
        ("Aad22111m", (None, "NON", ["gro", "man"], ["l", "l"], ["1a", "2keto", "3d", "9d"])), ("u4334h", (None, "HEX", ["gal"], [None], [])), ("uxxdxm", (None, "HEX", [], [], ["4d", "6d"])), ("a26h", (None, "TETRA", ["ery"], ["d"], [])),
        ("a48h", (None, "TETRA", ["ery"], [None], [])), ("h2h", ("uncyclized", "TRI", ["gro"], ["d"], ["1aldi"])), ("a2h", (None, "TRI", ["gro"], ["d"], [])), ("uFf22m", (None, "HEX", ["ery"], ["d"], ["2enx", "3d", "6d"])), ("hxxxxxxxh", ("uncyclized", "NON", [], [], ["1aldi"])),
    ],
)
def test_skeletons(spark, skeleton, want):
    r = wurcs.decoded(spark.createDataFrame([(skeleton,)], "unit string")).first()
    assert r["reason"] is None
    assert (r["anomer"], r["superclass"], r["stems"], r["configs"], [f"{m['pos']}{m['mod']}" for m in r["mods"]]) == want


def test_codes_that_cannot_be_read(spark):
    codes = {"a2122h-1b_1-5_2*XX": "unsupported substituent", "a2122h-1b_1-5_2": "bad code", "h2122h-1b": "anomer of an open chain", "b2122h": "unsupported skeleton", "": "bad code", "a2122h-1c": "bad code"}
    rows = wurcs.decoded(spark.createDataFrame([*((c,) for c in codes), (None,)], "unit string")).collect()
    assert {r["unit"]: r["reason"] for r in rows} == codes
