import itertools
import math

import pytest

from sugarmill.operators import isotopes

#: An element with gaps (neutrons 2 and 4), one with a heavy isotope that is never taken, one with a single isotope.
TABLE = [("S", 0, 31.97, 0.95), ("S", 2, 33.97, 0.04), ("S", 4, 35.97, 0.01), ("A", 0, 10.0, 0.7), ("A", 1, 11.002, 0.3), ("D", 0, 2.0, 1.0), ("D", 1, 3.0, 0.0), ("F", 0, 19.0, 1.0)]


def brute(formula, offsets=5, least=1e-5):
    """Every assignment of isotopes to atoms."""
    atoms = [[(k, m, p) for e, k, m, p in TABLE if e == x and p > 0] for x, n in formula for _ in range(n)]
    ways = {}
    for choice in itertools.product(*atoms):
        kind = tuple(sorted(zip([x for x, n in formula for _ in range(n)], choice, strict=True)))
        p, n = ways.get(kind, (0.0, 0))
        ways[kind] = (p + math.prod(c[2] for c in choice), sum(c[0] for c in choice))
    light = sum(min(a)[1] for a in atoms)
    peaks = {}
    for kind, (p, off) in ways.items():
        if p > least and off <= offsets:
            mass = sum(c[1] for _, c in kind)
            peaks.setdefault(math.floor(mass - light + 0.5), []).append((p, mass))
    return {k: (sum(p for p, _ in v), sum(p * m for p, m in v) / sum(p for p, _ in v)) for k, v in peaks.items()}


@pytest.mark.parametrize("formula", [[("A", 3)], [("A", 2), ("S", 3)], [("D", 2), ("F", 1), ("S", 1)]])
def test_clusters_equal_all_assignments(spark, formula):
    formula_key = [(x, n) for x, n in formula]
    brute_rows = brute([(x, n) for x, n in formula_key])
    rows = isotopes.clusters(spark.createDataFrame([(7, x, n) for x, n in formula], "id long, element string, n long"), spark.createDataFrame(TABLE, "element string, neutrons int, mass double, share double"), "id").collect()
    total, top = sum(p for p, _ in brute_rows.values()), max(p for p, _ in brute_rows.values())
    assert {r["peak"] for r in rows} == set(brute_rows)
    for r in rows:
        p, mass = brute_rows[r["peak"]]
        assert r["mass"] == pytest.approx(mass) and r["share"] == pytest.approx(p / total) and r["percent"] == pytest.approx(100 * p / top)


def test_odd_formulas(spark):
    table = spark.createDataFrame(TABLE, "element string, neutrons int, mass double, share double")
    rows = spark.createDataFrame([(1, "A", 0), (2, "Q", 3), (2, "A", 1), (3, "F", 2), (4, "F", 2), (5, None, 1), (6, "A", None)], "id long, element string, n long")
    assert sorted((r["id"], r["peak"], r["mass"], r["spacing"]) for r in isotopes.clusters(rows, table, "id").collect()) == [(3, 0, 38.0, 0.0), (4, 0, 38.0, 0.0)]
    assert isotopes.clusters(rows.limit(0), table, "id").count() == 0
