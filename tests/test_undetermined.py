from sugarmill.operators import undetermined as ops

TREE = "RES\n1b:b-glc-HEX\n2b:b-glc-HEX\n3b:a-man-HEX\nLIN\n1:1o(4+1)2d\n2:2o(4+1)3d"
SUB = "UND{0}:100.0:100.0\nParentIDs:2|3\nSubtreeLinkageID1:o({1}+2)d\nRES\n{2}b:a-gal-HEX\n{3}b:a-gro-NON"
TEXTS = {
    1: TREE, 2: f"{TREE}\nUND\n{SUB.format(1, 3, 4, 5)}\nLIN\n3:4o(3+2)5d\n{SUB.format(2, -1, 6, 7)}\nLIN\n4:6o(3+2)7d", 3: None, 4: "", 5: f"{TREE}\nUND\nUND1:100.0:100.0\nRES\n4b:a-gal-HEX", 6: f"{TREE}\nLIN", 7: "LIN\n1:1o(4+1)2d\nRES\n1b:x",
    8: f"{TREE}\nUND\n{SUB.format(1, 3, 4, 5)}", 9: f"{TREE}\nUND\nUND1:1:1\nParentIDs:9\nSubtreeLinkageID1:o(3+1)d\nRES\n4b:a-gal-HEX", 10: "RES\n1b:x\n2b:y", 11: f"{TREE}\nUND\nhello",
}


def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string")


def test_reasons(spark):
    got = {r["id"]: r["reason"] for r in ops.rejects(docs(spark), "id", "text").collect()}
    assert got == {5: "incomplete subtree", 6: "repeated section", 7: "LIN before RES", 8: "unconnected count", 9: "parent missing", 11: "bad line"}


def test_links_of_two_subtrees(spark):
    rows = ops.undetermined_links(docs(spark), "id", "text").filter("id = 2").collect()
    assert sorted((r["und"], r["parent"], r["parent_pos"], r["child_pos"], r["child"]) for r in rows if r["parent_pos"]) == [(1, 2, 3, 2, 4), (1, 3, 3, 2, 4)]
    assert sorted((r["parent"], r["child"]) for r in rows if r["parent_pos"] is None) == [(2, 6), (3, 6)]


def test_round_trip(spark):
    from pyspark.sql import functions as F

    tree = spark.createDataFrame([(2, TREE)], "id long, text string")
    subs = spark.createDataFrame(
        [(2, k, [3, 2], f"o({p}+2)d", [f"{r}b:a-gal-HEX", f"{r + 1}b:a-gro-NON"], [f"{k + 2}:{r}o(3+2){r + 1}d"]) for k, p, r in ((2, -1, 6), (1, 3, 4))],
        "id long, und int, parents array<long>, linkage string, residues array<string>, links array<string>",
    )
    assert ops.with_subtrees(tree, subs, "id").first()["text"] == TEXTS[2]
    assert ops.with_subtrees(tree, subs.filter(F.lit(False)), "id").first()["text"] == TREE
