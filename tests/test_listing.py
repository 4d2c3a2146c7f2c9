from sugarmill.operators import residues


def test_predicates_of_unknown_rings_and_no_mods(spark):
    rows = spark.createDataFrame([(1, 0, 0, ["6:d", "3:d", "1:aldi"]), (2, 0, None, []), (3, 1, 5, None)], "residue long, ring_start int, ring_end int, mods array<string>")
    got = sorted((r.residue, r.noring, r.kind or "", r.n) for r in residues.predicates(rows).collect())
    assert got == [(1, True, "aldi", 1), (1, True, "d", 2), (2, False, "", 0), (3, False, "", 0)]
    assert residues.predicates(rows.limit(0)).collect() == []


def test_listing_shows_the_state_of_links(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(4)] + [(2, 0)], "glycan_id long, node long")
    links = spark.createDataFrame([(1, 0, 1, True), (1, 0, 2, False), (1, 1, 2, False)], "glycan_id long, parent long, child long, settled boolean")
    got = {(r.glycan_id, r.node): (r.parents, r.children) for r in residues.listing(nodes, links).collect()}
    assert got == {(1, 0): ("", "->1,~>2"), (1, 1): ("->0", "~>2"), (1, 2): ("~>0,~>1", ""), (1, 3): ("", ""), (2, 0): ("", "")}
