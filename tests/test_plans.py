"""Physical-plan properties the design relies on at scale."""
import re

import pytest

import __spark_entry__ as E
from support import SF_SMALL


def _executed(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_shuffled_once_for_join_and_max_spend(spark):
    plan = _executed(spark, "segment_stats")
    assert "ReusedExchange" in plan


def test_validation_reads_its_input_once(spark):
    plan = _executed(spark, "validation_summary")
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["chat_window", "similar_customers"])
def test_rank_limit_runs_below_the_exchange(spark, name):
    assert "WindowGroupLimit" in _executed(spark, name)


def test_scans_read_only_needed_columns(spark):
    plan = _executed(spark, "segment_stats")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all(s.count(":") <= 2 for s in schemas), schemas


def test_aggregates_are_partial_before_the_shuffle(spark):
    plan = _executed(spark, "rfm_high_pct")
    assert "partial_count" in plan or "partial_sum" in plan


def test_scoring_is_one_projection_without_python(spark):
    plan = _executed(spark, "score_requests")
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastHashJoin" in plan  # the k-row cluster map


def test_nearest_center_needs_no_statistics_pass(spark):
    df = E.queries()["nearest_centroid"](spark, SF_SMALL)
    assert "stddev" not in df._jdf.queryExecution().executedPlan().toString()


def test_drift_reads_the_order_aggregate_once(spark):
    plan = _executed(spark, "segment_drift").split("Initial Plan")[0]
    assert "ReusedExchange" in plan or len(re.findall(r"FileScan parquet [^\n]*o_", plan)) <= 2
