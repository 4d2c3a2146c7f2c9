from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from sugarmill.operators import pixels


def runs_of(points):
    out = []
    for y, x in sorted(points):
        if out and out[-1][0] == y and out[-1][2] == x - 1:
            out[-1][2] = x
        else:
            out.append([y, x, x])
    return out


def flooded(points):
    """Regions by flood fill, each as its set of points."""
    left, regions = set(points), []
    while left:
        todo = [left.pop()]
        seen = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            seen |= near
            todo += near
        regions.append(seen)
    return regions


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 12)), max_size=90))
def test_runs_join_as_a_flood_fill(points):
    runs = runs_of(points)
    first = pixels.first_of_region(*map(list, zip(*runs))) if runs else []
    found = defaultdict(set)
    for (y, low, high), f in zip(runs, first):
        found[f] |= {(y, x) for x in range(low, high + 1)}
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, flooded(points)))
    assert all(tuple(runs[f][:2]) == min(p) for f, p in found.items())


def test_regions_of_images_and_colours(spark):
    ring = [(y, x) for y in range(5) for x in range(5) if 0 in (y, x) or 4 in (y, x)]
    rows = [(1, "red", y, x) for y, x in [*ring, (2, 2)]] + [(1, "blue", 0, 0), (2, "red", 0, 0), (2, "red", 1, 1), (2, "red", 3, 0)]
    got = sorted(tuple(r) for r in pixels.regions(spark.createDataFrame(rows, "image_id long, colour string, y int, x int")).collect())
    assert got == [(1, "blue", 0, 0, 0, 1, 1, 1), (1, "red", 0, 0, 0, 5, 5, 16), (1, "red", 200002, 2, 2, 1, 1, 1), (2, "red", 0, 0, 0, 2, 2, 2), (2, "red", 300000, 0, 3, 1, 1, 1)]
    assert pixels.regions(spark.createDataFrame([], "image_id long, colour string, y int, x int")).count() == 0


def test_areas_of_shapes(spark):
    """Outlines through the middles of border pixels: a square of 4 x 4 pixels encloses 9, a line nothing; holes stay open."""
    shapes = {
        1: [(y, x) for y in range(4) for x in range(4)], 2: [(0, x) for x in range(9)], 3: [(5, 5)],
        4: [(y, x) for y in range(5) for x in range(5) if (y, x) != (2, 2)], 5: [(y, x) for y in range(6) for x in range(3 + (y % 2) * 4)],
    }
    rows = spark.createDataFrame([(i, "red", y, x) for i, points in shapes.items() for y, x in points], "image_id long, colour string, y int, x int")
    got = {r["image_id"]: (r["n"], r["area"]) for r in pixels.areas(rows).collect()}
    want = {}
    for i, points in shapes.items():
        there = set(points)
        border = sum(not {(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)} <= there for y, x in points)
        want[i] = (len(points), len(points) - border / 2 - 1)
    assert got == want
    assert got[1] == (16, 9.0) and pixels.areas(rows.limit(0)).count() == 0


def test_colours_of_a_pixel_in_one_pass(spark):
    """Ranges that overlap, of one colour or of two; the pixels themselves are not shuffled."""
    ranges = spark.createDataFrame([("red", 0, 0, 0, 19, 255, 255), ("red", 10, 0, 0, 30, 255, 255), ("warm", 0, 0, 0, 40, 255, 255), ("blue", 87, 0, 0, 134, 255, 255)], "colour string, h_lo int, s_lo int, v_lo int, h_hi int, s_hi int, v_hi int")
    rows = spark.createDataFrame([(1, 0, k, h, 9, 9) for k, h in enumerate((15, 25, 35, 87, 134, 150))], "image_id long, y int, x int, h int, s int, v int")
    found = pixels.coloured(rows, ranges)
    assert sorted((r.x, r.colour) for r in found.collect()) == [(0, "red"), (0, "warm"), (1, "red"), (1, "warm"), (2, "warm"), (3, "blue"), (4, "blue")]
    assert "hashpartitioning(image_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert pixels.coloured(rows, ranges.limit(0)).count() == 0


def test_boxes_are_dealt_by_image_before_they_are_painted(spark):
    from sugarmill.plans import pixels as plans
    from tests.test_oracle import SF_DIR

    plan = plans.coloured(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


@given(st.lists(st.sets(st.tuples(st.integers(-3, 6), st.integers(-4, 9)), min_size=1, max_size=60), min_size=1, max_size=6))
def test_regions_of_all_groups_of_a_batch_are_found_at_once(groups):
    """One pass over the runs of a batch, whatever its groups; regions and their pixels that are no border as by flood fill."""
    import pyarrow as pa

    of_run = lambda r: {"y": r[0], "x1": r[1], "x2": r[2], "n": r[2] - r[1] + 1}
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("y", "x1", "x2", "n")]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(groups))), pa.array(["red"] * len(groups)), pa.array([[of_run(r) for r in runs_of(g)] for g in groups], run)], names=["image_id", "colour", "runs"])
    calls, join = [], pixels.first_of_region
    pixels.first_of_region = lambda *x: calls.append(x) or join(*x)
    try:
        found = [r for b in pixels.joined_runs(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    finally:
        pixels.first_of_region = join
    want = []
    for k, points in enumerate(groups):
        for region in flooded(points):
            ys, xs = zip(*region)
            inner = sum({(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)} <= region for y, x in region)
            want.append((k, *min(region), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(region), inner))
    assert sorted((r["image_id"], r["begin"]["y"], r["begin"]["x1"], r["x"], r["y"], r["w"], r["h"], r["n"], r["inner"]) for r in found) == sorted(want)
    assert len(calls) == 1
