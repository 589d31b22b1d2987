"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from millwright.plans.queries import ORACLES, QUERIES

#: One or two of each family; the rest differ in expressions only.
CHOSEN = """task_summary node_summary metric_percentiles quantile_summary cluster_stats decision_usage benchmark_matrix balance_metrics gini schedule_metrics compare_distribution
ema_compile_time ema_compile_time_by_day forecast_load running_compile_totals small_task_batches resolve_includes size_band_estimate concurrency_peak queue_waits dependency_status
rank_nodes_weighted edge_jaccard edge_diff link_markers topological_levels upward_rank critical_path cyclic_nodes dependency_clusters validate_graph incremental_plan
flag_signature sanitize_flags source_complexity parse_log_event read_compile_db read_dep_files read_hosts apply_retention stream_event_counters stream_ema
parse_session_log read_makefile_rules read_task_order_table read_bench_summary stream_status_snapshots
content_hash needs_rebuild_flag fit_compile_model predict_compile_time project_fingerprint rank_nodes_fastest parse_log_udtf read_run_results read_stats_page
stream_node_state stream_backoff stream_heartbeat_sessions progress_counters stream_long_pending repair_cycles
load_telemetry running_success_rate status_changes robust_estimate""".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_and_sql_give_the_same_rows(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    result = db.execute(ORACLES[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    theirs = sorted((tuple(row[named.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert mine == theirs
    assert mine


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
