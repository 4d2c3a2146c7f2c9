import datetime as dt

import pytest

from sugarmill.operators import detections
from sugarmill.streaming import arriving

ROW = "det_id long, imwidth int, imheight int, rel_cen_x double, rel_cen_y double, rel_w double, rel_h double, scores array<double>"
SCHEMA = f"image_id long, ts timestamp, rows array<struct<{ROW.replace(' long', ':long').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"
START = dt.datetime(2024, 1, 1)


def image(k, hours, boxes=((0.3, 0.9), (0.31, 0.8), (0.7, 0.5), (0.5, 0.1))):
    return (k, START + dt.timedelta(hours=hours), [(100 * k + i, 640, 400, x, 0.5, 0.1, 0.1, [c, 0.0]) for i, (x, c) in enumerate(boxes)])


def deliver(spark, inbox, *images):
    spark.createDataFrame(list(images), SCHEMA).coalesce(1).write.mode("append").parquet(inbox)


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out"


def kept(spark, places, **more):
    rows = arriving.suppressed(spark, places[0], spark.createDataFrame([], SCHEMA).schema, places[1], **more).collect()
    assert len({(r.image_id, r.det_id) for r in rows}) == len(rows)
    return {k: sorted(r.det_id - 100 * k for r in rows if r.image_id == k) for k in {r.image_id for r in rows}}


def test_late_and_repeated_files_count_once(spark, places):
    deliver(spark, places[0], image(1, 0), image(2, 5))
    deliver(spark, places[0], image(3, 6), image(1, 0))
    assert kept(spark, places, files=1) == {1: [0, 2], 2: [0, 2], 3: [0, 2]}
    deliver(spark, places[0], image(4, 1), image(2, 5))  # late, and again, in a later run
    assert kept(spark, places) == {1: [0, 2], 2: [0, 2], 3: [0, 2], 4: [0, 2]}
    assert kept(spark, places) == {1: [0, 2], 2: [0, 2], 3: [0, 2], 4: [0, 2]}  # no new file


def test_too_late(spark, places):
    deliver(spark, places[0], image(1, 100))
    kept(spark, places, late="2 hours")
    deliver(spark, places[0], image(2, 99), image(3, 1))
    assert set(kept(spark, places, late="2 hours")) == {1, 2}


def test_images_without_rows(spark, places):
    deliver(spark, places[0], (1, START, []), (2, START, None), image(3, 0, ((0.5, 0.1),)), image(4, 0, ((0.5, 0.9),)))
    assert kept(spark, places) == {4: [0]}


def test_equals_one_batch(spark, places):
    images = [image(k, k % 7, tuple((0.1 + (k * j * 7 % 80) / 100, (k * j * 13 % 97) / 100) for j in range(1, 9))) for k in range(1, 40)]
    for k in range(0, 39, 13):
        deliver(spark, places[0], *images[k : k + 13])
    rows = spark.createDataFrame([(i, *r) for i, _, found in images for r in found], f"image_id long, {ROW}")
    want = detections.non_max_suppression(detections.decode(detections.arg_max(rows), 200), 0.3, 0.4)
    found = {}
    for r in want.collect():
        found.setdefault(r.image_id, []).append(r.det_id - 100 * r.image_id)
    assert kept(spark, places, files=1) == {k: sorted(v) for k, v in found.items()}
