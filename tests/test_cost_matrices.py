"""Cost matrices: every pair of rows, repeated rows too, with its own cost, and in few bytes when written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millwright.operators import joins

MATRICES = {
    "exec": lambda tasks, nodes: joins.exec_cost_matrix(tasks, nodes, F.col("time"), F.col("cuda")).select("id", "node_id", "cost"),
    "comm": lambda tasks, nodes: joins.comm_cost_matrix(tasks, nodes, F.col("time")).select("id", "node_id", "comm"),
}


@pytest.fixture
def joined_by_pairs(spark):
    """No broadcasts, as for tables beyond Spark's bound."""
    bound = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(bound)
    spark.conf.set(bound, -1)
    yield
    spark.conf.set(bound, before)


@pytest.mark.parametrize("kind", MATRICES)
def test_tiles_hold_few_bytes(spark, tmp_path, joined_by_pairs, kind):
    tasks = spark.range(160).selectExpr("id", "id % 50 as time", "id % 4 = 2 as cuda")
    nodes = spark.range(5000).selectExpr("id as node_id", "element_at(array(2.0d, 1.0d, 0.5d), int(id % 3) + 1) as weight", "id * 7 % 300 as latency_ms")
    MATRICES[kind](tasks, nodes).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 800_000
    assert sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/out")) < {"exec": 400_000, "comm": 1_000_000}[kind]


@pytest.mark.parametrize("kind", MATRICES)
def test_every_pair_of_odd_rows(spark, kind):
    tasks = [(1, 8, True, "a"), (1, 8, True, "a"), (2, None, False, None), (3, 0, None, "c"), (None, 5, True, "d"), *((k, k % 7, k % 2 == 0, "e") for k in range(10, 90))]
    nodes = [(0, 2.0, 90), (1, 2.0, 90), (1, 2.0, 90), (None, 1.0, 30), (5, None, None), *((k, 0.25 * (1 + k % 9), k % 11) for k in range(10, 300))]
    t, n = spark.createDataFrame(tasks, "id long, time long, cuda boolean, note string"), spark.createDataFrame(nodes, "node_id long, weight double, latency_ms long")
    exec_cost = F.col("time") / F.col("weight") * F.when(F.col("cuda") & (F.col("node_id") != 0), 1000).otherwise(1)
    comm_cost = F.when(F.col("node_id") == 0, 0.0).otherwise(F.col("latency_ms") / 1000 + F.col("time") / 12_800)
    name, cost = ("cost", F.round(exec_cost, 6)) if kind == "exec" else ("comm", F.round(comm_cost, 9))
    wanted = t.crossJoin(n).withColumn(name, cost).select("id", "node_id", name)
    found = MATRICES[kind](t, n)
    assert found.count() == len(tasks) * len(nodes)
    assert found.exceptAll(wanted).count() == wanted.exceptAll(found).count() == 0
    assert MATRICES[kind](t, n.limit(0)).count() == MATRICES[kind](t.limit(0), n).count() == 0


def test_other_columns_stay(spark):
    t = spark.createDataFrame([(1, 8, True, "a", "b")], "id long, time long, cuda boolean, `a.b` string, note string")
    n = spark.createDataFrame([(3, 2.0, 90)], "node_id long, weight double, latency_ms long")
    found = joins.exec_cost_matrix(t, n, F.col("time"), F.col("cuda"))
    assert found.columns == ["id", "time", "cuda", "a.b", "note", "node_id", "weight", "cost"]
    assert list(map(tuple, found.collect())) == [(1, 8, True, "a", "b", 3, 2.0, 4000.0)]
    found = joins.comm_cost_matrix(t, n, t["time"])
    assert found.columns == ["id", "time", "cuda", "a.b", "note", "node_id", "comm"]
    assert list(map(tuple, found.collect())) == [(1, 8, True, "a", "b", 3, round(0.09 + 8 / 12_800, 9))]


@pytest.mark.parametrize("kind", MATRICES)
@pytest.mark.parametrize("n_tasks, n_nodes", [(12_000, 30), (160, 20_000)])
def test_no_side_is_broadcast_or_in_one_task(spark, kind, n_tasks, n_nodes):
    """Whichever table is larger; a broadcast of bundles joins all of them with a row before the first pair goes on."""
    tasks = spark.range(n_tasks).selectExpr("id", "id % 50 as time", "id % 4 = 2 as cuda")
    nodes = spark.range(n_nodes).selectExpr("id as node_id", "element_at(array(2.0d, 1.0d, 0.5d), int(id % 3) + 1) as weight", "id * 7 % 300 as latency_ms")
    found = MATRICES[kind](tasks, nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(parts) == n_tasks * n_nodes
    assert max(parts) < sum(parts) / 3
