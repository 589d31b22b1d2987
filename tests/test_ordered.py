"""Ordered groups that lie in many parts: a busy group, null keys, repeated times, an empty table."""

from __future__ import annotations

import random
import statistics
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millwright.operators import balance, joins, reports, windows
from millwright.operators.ordered import in_order, median


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small ranges are not put together again, so that groups do lie in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _rows(seed: int, n: int = 600) -> list[tuple]:
    """(k, t, id, x, y): a third in one group, another in the null one; times repeat; x and y are often unknown."""
    rng = random.Random(seed)
    some = lambda v: rng.choice((None, v, v))
    return [(rng.choice((1, 1, None, None, rng.randrange(2, 9), 50 + i)), some(rng.randrange(40)), i, some(rng.randrange(100)), some(rng.random())) for i in range(n)]


def _groups(rows: list[tuple]) -> list[list[tuple]]:
    key = lambda r: (r[0] is not None, r[0] or 0)
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    return [sorted(g, key=place) for _, g in groupby(sorted(rows, key=key), key)]


@pytest.mark.parametrize("seed", (1, 2))
def test_places_sums_latest_values_and_neighbours(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "k long, t long, id long, x long, y double")
    found = in_order(df, ["k"], ["t", "id"], sums={"total": F.col("x")}, lasts={"latest": F.col("x")}, before={"x_before": F.col("x")}, after={"x_after": F.col("x")})
    mine = {r["id"]: tuple(r)[5:] for r in found.collect()}
    expected = {}
    for g in _groups(rows):
        total = latest = None
        for i, r in enumerate(g):
            total, latest = (total or 0) + (r[3] or 0), latest if r[3] is None else r[3]
            expected[r[2]] = (i + 1, len(g), total, latest, g[i - 1][3] if i else None, g[i + 1][3] if i + 1 < len(g) else None)
    assert found.columns[5:] == ["__i", "__n", "total", "latest", "x_before", "x_after"]
    assert mine == expected
    assert in_order(df.limit(0), ["k"], ["t", "id"], sums={"total": F.col("x")}).count() == 0


def test_a_busy_group_lies_in_several_parts(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    assert df.repartitionByRange("k", "id").select(F.spark_partition_id()).distinct().count() > 1
    assert in_order(df, ["k"], ["id"]).filter("__i <> id + 1 or __n <> 4000").count() == 0
    assert in_order(df, [], ["id"]).filter("__i <> id + 1 or __n <> 4000").count() == 0


def test_medians_and_deviations_keep_the_null_group(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "k long, t long, id long, x long, y double")
    known = {g[0][0]: [r[4] for r in g if r[4] is not None] for g in _groups(rows)}
    known = {k: v for k, v in known.items() if v}
    assert {r["k"]: r["median"] for r in median(df, ["k"], "y").collect()} == pytest.approx({k: statistics.median(v) for k, v in known.items()})
    mad = {k: statistics.median(abs(y - statistics.median(v)) for y in v) for k, v in known.items()}
    assert {r["k"]: r["mad"] for r in reports.robust_estimate(df, ["k"], "y").collect()} == pytest.approx(mad, abs=1e-4)
    percentiles = {r["k"]: (r["n"], r["median"]) for r in reports.metric_percentiles(df, ["k"], "y").collect()}
    assert {k: n for k, (n, _) in percentiles.items()} == {k: len(v) for k, v in known.items()}
    assert percentiles[None][1] == pytest.approx(statistics.median(known[None]), abs=1e-4)
    summary = {r["k"]: r["p95"] for r in reports.quantile_summary(df, ["k"], "y", F.col("y").isNotNull()).collect()}
    assert summary[None] == pytest.approx(statistics.quantiles(known[None], n=20)[18], abs=1e-4)


def test_operators_over_nodes_with_most_of_the_rows(spark):
    rng = random.Random(4)
    status = lambda: rng.choice(("completed", "failed", None))
    tasks = [(i, rng.choice((1, 1, 1, None, 2, 3)), rng.randrange(300), status()) for i in range(500)]
    df = spark.createDataFrame(tasks, "task_id long, node_id long, at long, status string").withColumn("completed_at", F.timestamp_seconds("at"))
    rates, changes = {}, set()
    for g in _groups([(n, at, i, s) for i, n, at, s in tasks]):
        known = good = 0
        for j, (_, _, i, s) in enumerate(g):
            known, good = known + (s is not None), good + (s == "completed")
            rates[i] = round(good / known, 6) if known else None
            if s != (g[j - 1][3] if j else None):
                changes.add(i)
    assert {r["task_id"]: r["rate"] for r in windows.running_success_rate(df).collect()} == rates
    assert {r["task_id"] for r in windows.status_changes(df).collect()} == changes

    kinds = ("COMPILE_OK", "TCP_ACCEPT", "COMPILE_ERROR")
    events = [(i, rng.choice((1, 1, None, 2)), rng.choice((None, rng.randrange(5000), rng.randrange(5000))), rng.choice(kinds)) for i in range(800)]
    stats = spark.createDataFrame(events, "id long, node_id long, sec long, kind string").withColumn("stopped_at", F.timestamp_seconds("sec"))
    mine = {r["id"]: (r["last_60"], r["last_300"], r["last_900"]) for r in windows.running_compile_totals(stats).collect()}
    hits = lambda n, s, span: sum(k != "TCP_ACCEPT" for _, m, at, k in events if m == n and ((s is None and at is None) or (s is not None and at is not None and s - span < at <= s)))
    assert mine == {i: tuple(hits(n, s, span) for span in (60, 300, 900)) for i, n, s, _ in events}


def test_finish_times_without_one_ordered_task(spark):
    rng = random.Random(5)
    ends = [rng.randrange(1, 90) for _ in range(400)]
    plan = spark.createDataFrame([(i, i % 7, 0, e) for i, e in enumerate(ends)], "task_id long, machine long, start long, end long")
    edges = spark.createDataFrame([(0, 1), (0, 7)], "src long, dst long")
    one = balance.schedule_metrics(plan, edges).collect()[0]
    assert (one["makespan"], one["p95"], one["cross_edges"]) == (max(ends), sorted(ends)[int(400 * 0.95)], 1)
    assert joins.concurrency_peak(plan, ["machine"], "start", "end").filter("machine = 0").collect()[0]["peak"] == sum(i % 7 == 0 for i in range(400))
