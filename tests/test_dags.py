import itertools
import random

import pytest

from sugarmill.operators import dags


def isomorphic(a, b):
    """By all matchings of nodes."""
    (la, ea), (lb, eb) = a, b
    if sorted(la) != sorted(lb) or len(ea) != len(eb):
        return False
    for p in itertools.permutations(range(len(lb))):
        if all(la[i] == lb[p[i]] for i in range(len(la))) and {(p[x], p[y], t) for x, y, t in ea} == eb:
            return True
    return False


def tables(spark, found):
    nodes = [(g, i, x) for g, (labels, _) in found.items() for i, x in enumerate(labels)]
    links = [(g, x, y, t) for g, (_, edges) in found.items() for x, y, t in edges]
    return spark.createDataFrame(nodes, "glycan_id long, node int, label string"), spark.createDataFrame(links, "glycan_id long, parent int, child int, label string")


def test_classes_equal_all_matchings(spark):
    rng = random.Random(4)
    found = {}
    for g in range(60):
        n = rng.randint(1, 5)
        labels = [rng.choice("HHHS") for _ in range(n)]
        edges = {(rng.randrange(c), c, rng.choice("oou")) for c in range(1, n)} | {(rng.randrange(c), c, "u") for c in range(2, n) if rng.random() < 0.5}
        p = rng.sample(range(n), n)
        found[g] = [labels[p.index(i)] for i in range(n)], {(p[x], p[y], t) for x, y, t in edges}
    rows = {r["glycan_id"]: r for r in dags.equal_candidates(*tables(spark, found)).collect()}
    assert set(rows) == set(found)
    for a, b in itertools.combinations(found, 2):
        if isomorphic(found[a], found[b]):
            assert rows[a]["class_id"] == rows[b]["class_id"]
        elif rows[a]["decided"] and rows[b]["decided"]:
            assert rows[a]["class_id"] != rows[b]["class_id"]
    assert sum(r["decided"] for r in rows.values()) > 50


def ring(sizes):
    """Rings of undirected links, each way round."""
    edges, at = set(), 0
    for n in sizes:
        edges |= {(at + i, at + (i + 1) % n, "u") for i in range(n)}
        at += n
    return ["H"] * at, edges


def test_symmetric_graphs_are_parted_or_reported(spark):
    found = {1: ring([6]), 2: ring([3, 3]), 3: ring([6]), 4: ring([3, 3])}
    plain = {r["glycan_id"]: r for r in dags.equal_candidates(*tables(spark, found), single_out=False).collect()}
    assert {r["class_id"] for r in plain.values()} == {1} and not any(r["decided"] for r in plain.values())
    again = {r["glycan_id"]: (r["class_id"], r["decided"]) for r in dags.equal_candidates(*tables(spark, found)).collect()}
    assert again[1] == again[3] == (1, True)
    assert again[2][0] == again[4][0] != 1 or not again[2][1]


def test_odd_rows(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 0, None), (1, 1, "H"), (2, 5, None), (2, 9, "H"), (None, 0, "H"), (3, None, "H"), (4, 0, "x" * 100_000)], "glycan_id long, node int, label string")
    links = spark.createDataFrame([(1, 0, 1, None), (1, 0, 1, None), (1, 0, 7, "o"), (2, 5, 9, None), (2, None, 9, "o"), (9, 0, 1, "o")], "glycan_id long, parent int, child int, label string")
    rows = {r["glycan_id"]: (r["class_id"], r["n_nodes"], r["decided"]) for r in dags.equal_candidates(nodes, links).collect()}
    assert rows == {1: (1, 2, True), 2: (1, 2, True), 4: (4, 1, True)}
    assert dags.equal_candidates(nodes.limit(0), links.limit(0)).count() == 0


@pytest.mark.parametrize("single", [True, False])
def test_no_links(spark, single):
    nodes = spark.createDataFrame([(1, 0, "H"), (1, 1, "H"), (2, 3, "H"), (2, 4, "H"), (3, 0, "S"), (3, 1, "H")], "glycan_id long, node int, label string")
    links = spark.createDataFrame([], "glycan_id long, parent int, child int, label string")
    rows = {r["glycan_id"]: r["class_id"] for r in dags.equal_candidates(nodes, links, single_out=single).collect()}
    assert rows == {1: 1, 2: 1, 3: 3}
