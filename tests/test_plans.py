"""Plans keep the shape they need at scale."""

import os

import pytest

import __spark_entry__ as entry
from banfleet import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

BATCH_QUERIES = sorted(n for n in plans.queries() if not n.startswith("stream_"))


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(spark, "outbox_depth_age")
    assert "props" in text and "value" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(spark, "delivery_flags")
    assert "event_type" not in text


def test_top_n_limits_before_the_shuffle(spark):
    for name in ("outbox_head", "recent_applied"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_counts_are_hash_aggregates(spark):
    for name in ("outbox_depth_age", "ban_counts_by_segment", "delivery_flags"):
        text = plan(spark, name)
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_parse_stays_in_the_jvm(spark):
    for name in ("parse_bans", "report_batches", "applied_fleet", "fleet_status"):
        text = plan(spark, name)
        assert "Python" not in text and "MapInArrow" not in text
