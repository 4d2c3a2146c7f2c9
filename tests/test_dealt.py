"""Boxes are dealt by image once, to tasks of a bounded share; what follows by image needs no further exchange."""

import pytest

from sugarmill.plans import registry
from sugarmill.sources import derived
from tests.test_oracle import SF_DIR


def test_a_share_does_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(derived, "BOXES", 50)
    boxes = derived.truth(spark, SF_DIR)
    dealt = derived.dealt(boxes)
    assert dealt.rdd.getNumPartitions() == -(-boxes.count() // 50) and dealt.count() == boxes.count()


@pytest.mark.parametrize("name", ["mono_links", "mono_distance"])
def test_links_are_found_within_the_share(spark, name):
    plan = registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "")


def test_colours_are_compiled_with_the_plan(spark):
    from sugarmill.plans import pixels as plans

    plan = plans.coloured(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "BroadcastNestedLoopJoin" not in plan
