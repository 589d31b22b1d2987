"""What grows with the input, and how fast: groups of streams' keys, what loops send to the driver, files and tables written."""

from __future__ import annotations

import datetime as dt

import pytest

from millwright.operators import graph
from millwright.plans.queries import QUERIES
from millwright.sources import readers
from millwright.streaming import live

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(("job", "mode", "rows"), [(live.stream_ema, "update", 3000), (live.stream_backoff, "append", 3000), (lambda e: live.stream_release_ready(e.selectExpr("ts", "node_id as consumer", "1L as needs")), "append", 3000)])
def test_many_keys_share_a_state(spark, tmp_path, job, mode, rows):
    events = [(k, START + dt.timedelta(milliseconds=k), k, "failed", 1.0) for k in range(3000)]
    spark.createDataFrame(events, live.EVENTS).write.parquet(f"{tmp_path}/in")
    out = job(live.read_events(spark, f"{tmp_path}/in", files_per_batch=None))
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= live.GROUPS
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows


def test_a_stream_of_nothing(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["stream_ema"](spark, str(tmp_path)).count() == 0


def test_alerts_without_broadcasts(spark, sf_dir):
    """What a large table of missing dependencies comes to: it is joined by a shuffle."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        assert QUERIES["stream_long_pending"](spark, sf_dir).count() > 0
    finally:
        spark.conf.set(name, before)


def test_a_file_of_many_stats_pages(spark, tmp_path):
    page = "argv /distccd\n<distccstats>\nnode {}\nrq {}\n</distccstats>\n"
    (tmp_path / "many").write_text("".join(page.format(k, 2 * k) for k in range(50)) + "</tt></body></html>\n")
    (tmp_path / "bare").write_text("node 99\n")
    rows = sorted(map(tuple, readers.read_stats_page(spark, str(tmp_path), ["node", "rq"]).collect()))
    assert rows == [(float(k), 2.0 * k) for k in range(50)] + [(99.0, None)]


def test_loops_over_graphs_broadcast_nothing(spark):
    e = graph.cut_lineage(spark.range(10).selectExpr("0L as graph_id", "id as src", "id + 1 as dst"))
    plan = e.select("graph_id", "src").distinct().join(e.filter("dst > 3"), ["graph_id", "src"], "left_semi")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_include_closure_on_cycles(spark):
    pairs = [(k, (k + 1) % 11) for k in range(11)] + [(0, 5), (20, 0), (3, 3), (5, 30)]
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    edges = spark.createDataFrame(pairs, "src long, dst long")
    units = spark.createDataFrame([(k,) for k in {x for p in pairs for x in p}], "unit long")
    assert sorted(map(tuple, graph.include_closure(units, edges).collect())) == sorted(reach)
