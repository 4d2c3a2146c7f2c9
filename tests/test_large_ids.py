import pyarrow as pa
import pyarrow.parquet as pq

from sugarmill.operators import detections as ops
from sugarmill.plans import registry
from sugarmill.sources import derived


def test_ids_beyond_a_million(spark, tmp_path):
    keys = [*range(8), *range(1_000_000, 1_000_008), *range(2_000_000, 2_000_008)]
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array([1] * len(keys), pa.int64())}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"event_id": pa.array([0, 1_000_000], pa.int64())}), tmp_path / "events.parquet")
    det = derived.detections(spark, str(tmp_path))
    assert det.select("det_id").distinct().count() < det.count() == det.select("image_id", "det_id").distinct().count()
    run = lambda name: registry.queries()[name](spark, str(tmp_path))
    assert {tuple(r) for r in run("structure_gate").select("image_id", "symbols").collect()} >= {(125_000, 8)}
    assert run("nearest_truth").count() == det.count()
    kept = ops.non_max_suppression(det, 0.3).groupBy("image_id").count()
    assert {tuple(r) for r in run("annotate").select("image_id", "symbols").collect()} == {tuple(r) for r in kept.collect()}
