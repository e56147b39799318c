"""Physical-plan properties the operators are designed around."""

import pytest

from refinery.plans.registry import QUERIES

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan(fn(spark, SF_SMALL)) for k, fn in QUERIES.items()}


def test_no_cross_joins_anywhere(plans):
    for k, p in plans.items():
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, k


def test_no_row_at_a_time_python(plans):
    for k, p in plans.items():
        assert "BatchEvalPython" not in p, k


def test_clean_and_redact_are_narrow(plans):
    for k in ("clean_currency", "clean_phone", "clean_email", "clean_text_case", "clean_auto_detect"):
        assert "ArrowEvalPython" not in plans[k]
        assert "Exchange" not in plans[k], k


def test_dedup_is_one_hash_aggregate_shuffle(plans):
    p = plans["dedup_full"]
    assert p.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in p and "partial_min" in p


def test_keyed_dedup_partial_aggregate(plans):
    p = plans["dedup_keys"]
    assert p.count("Exchange hashpartitioning") == 1 and "partial_min" in p


def test_topn_uses_partial_window_group_limit(plans):
    for k in ("credit_history_topn", "context_chunks", "dataset_top_values"):
        assert "WindowGroupLimit" in plans[k] and "Partial" in plans[k], k


def test_filters_pushed_to_scan(plans):
    assert "PushedFilters: [EqualNullSafe(c_mktsegment,BUILDING), EqualNullSafe(c_nationkey,7)]" in plans["fetch_filtered"]
    assert "TakeOrderedAndProject" in plans["fetch_filtered"]


def test_column_pruning(plans):
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plans["dedup_full"]


def test_small_dimensions_broadcast(plans):
    assert "BroadcastHashJoin" in plans["crm_orders_by_nation"]
    assert "BroadcastHashJoin" in plans["usage_cost_rollup"]


def test_single_query_search_has_no_join(plans):
    p = plans["search_topk"]
    assert "TakeOrderedAndProject" in p and "Join" not in p


def test_running_balance_splits_hot_keys_by_range(plans):
    assert "windowspecdefinition(api_key" in plans["credit_running_balance"]
    assert "windowspecdefinition(api_key#" in plans["credit_running_balance"] and "_part" in plans["credit_running_balance"]


def scans(p: str) -> int:
    return p.count("FileScan parquet")


def test_every_query_reads_a_table(plans):
    for k, p in plans.items():
        assert scans(p) >= 1, k


def test_one_scan_per_table(plans):
    assert scans(plans["dataset_profile"]) == 2  # lineitem and customer
    assert scans(plans["sql_set_ops"]) == 2      # orders and customer
    assert scans(plans["credit_balance"]) == 2   # first events for the grants, and the moves
    assert scans(plans["context_totals"]) == 1
