"""Registered queries next to their reference SQL in DuckDB at the smallest scale.

Runs a spread over all modules; SKYLEDGER_ALL_QUERIES=1 runs every query.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SPREAD = """j02_asof_panel a07_panel_coverage w10_stop_scan j03_latest_before_per_key a05_readiness_summary
w04_recommended_models a16_opportunity_summary a23_l2_buckets a26_baseline_errors j18_filter_grid a28_time_forward_folds
k01_upsert k02_keep_last j19_backlog_merge u01_union_by_name s25_signal_reasons w21_best_trades s37_quotes s29_priority_scores
a01_training_rows j10_source_selection s12_model_spreads a37_feature_medians x01_normal_bins a34_model_evaluation j05_range_join
w05_execution_score s01_outcome_labels s02_rule_texts s06_decision_points s07_local_to_utc q04_inventory_issues
q05_collection_status i04_log_scan i07_sharded_inventory i11_page_maximum s04_grouped_events w06_expanding_folds o01_canonical_order
t10_consecutive_failures x06_gaussian_regression x17_rolling_backtest t02_running_summary t05_stop_alerts t11_live_panel""".split()
NAMES = list(entry.queries()) if os.environ.get("SKYLEDGER_ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())


def test_reference_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["city", "decision_horizon", "coverage_status", "token_count", "market_count"]
    assert out.count() > 0


def test_plans_have_no_pairwise_joins(spark, sf):
    for name in ("j02_asof_panel", "j05_range_join", "j18_filter_grid", "w21_best_trades", "q05_collection_status", "j10_source_selection"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keep_last_is_pruned_before_the_shuffle(spark, sf):
    plan = entry.queries()["k02_keep_last"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_needed_columns(spark, sf):
    plan = entry.queries()["a38_status_sums"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
