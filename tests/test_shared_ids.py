"""Ids that several images share from 1,000,000 orders on: the rows are still those of the SQL where it fixes them."""

import duckdb
import pytest

from sugarmill.plans import registry
from sugarmill.plans.detections import arrivals
from tests.compare import difference


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ids")
    duckdb.sql(f"COPY (SELECT o * 1000000 + k AS o_orderkey, 1::BIGINT AS o_custkey FROM range(3) a(o), range(400) b(k)) TO '{folder}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT o * 1000000 + k * 20 AS event_id FROM range(2) a(o), range(20) b(k)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["det_class_options", "root_by_box"])
def test_rows_equal_the_sql(spark, shared, name):
    assert difference(spark, registry.queries()[name], registry.oracle_sql()[name], shared) is None


def test_files_of_arriving_images_grow_with_them():
    assert arrivals(0) == arrivals(150_000) == 12 and arrivals(9_000_000) == 48
    assert all(n / arrivals(n) <= 200_000 for n in (9_000_000, 54_000_000))


def test_strict_annotation_equals_the_sql(spark, shared):
    assert difference(spark, registry.queries()["annotate_strict"], registry.oracle_sql()["annotate_strict"], shared) is None
