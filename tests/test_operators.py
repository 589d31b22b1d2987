"""Small cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import columns as C
from millwright.operators import balance, graph, joins, nodes
from millwright.sources import readers


def _graph(spark, weights: dict, pairs: list):
    v = spark.createDataFrame([(0, k, "compile", w) for k, w in weights.items()], "graph_id long, id long, node_type string, weight long")
    return v, spark.createDataFrame([(0, a, b) for a, b in pairs], "graph_id long, src long, dst long")


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_balance_of_published_counts(spark):
    counts = spark.createDataFrame([(1, i, c) for i, c in enumerate((23, 24, 24, 26, 23, 21, 20, 20, 18, 18))], "run int, node int, tasks long")
    r = balance.balance_metrics(counts, ["run"]).first()
    assert (r["total"], r["nodes"], round(r["mean"], 1), round(r["std"], 2), round(r["cv"], 2)) == (217, 10, 21.7, 2.71, 12.49)


def test_diamond(spark):
    v, e = _graph(spark, {1: 2, 2: 5, 3: 1, 4: 3}, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert _rows(graph.topological_levels(v, e), "id", "level") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    ranks = graph.upward_rank(v, e)
    assert _rows(ranks, "id", "rank") == [(1, 10), (2, 8), (3, 4), (4, 3)]
    assert _rows(graph.critical_path(ranks, e), "step", "id") == [(0, 1), (1, 2), (2, 4)]
    assert _rows(graph.ready_tasks(v, e, v.filter("id = 1")), "id") == [(2,), (3,)]


def test_cycle_with_tail_and_two_components(spark):
    v, e = _graph(spark, {1: 1, 2: 1, 3: 1, 7: 1, 8: 1}, [(1, 2), (2, 1), (2, 3), (7, 8)])
    assert _rows(graph.cyclic_nodes(v, e), "id") == [(1,), (2,)]
    assert _rows(graph.topological_levels(v, e), "id") == [(7,), (8,)]
    assert _rows(graph.dependency_clusters(v, e), "id", "cluster") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def test_failures_stop_at_finished_tasks(spark):
    v, e = _graph(spark, {1: 1, 2: 1, 3: 1, 4: 1}, [(1, 2), (2, 3), (1, 4)])
    assert _rows(graph.propagate_failures(v.filter("id = 1"), e, v.filter("id <> 2")), "id") == [(1,), (4,)]


def test_graphs_may_be_empty(spark):
    v, e = _graph(spark, {1: 1}, [])
    assert graph.topological_levels(v.limit(0), e).count() == 0
    assert _rows(graph.roots_leaves(v, e), "id", "orphan") == [(1, True)]
    assert nodes.set_jaccard(v.select("id").limit(0), v.select("id").limit(0)).first()["jaccard"] == 1.0


def test_flags(spark):
    args = spark.createDataFrame([(["g++", "-I", "a", "-Ib", "-D", "X", "-O2", "-Wall", "-o", "-Iodd", "-c", "f.c"],)], "a array<string>")
    r = args.select(C.include_paths(F.col("a")).alias("i"), C.sanitize_flags(F.col("a")).alias("s"), C.dependency_flags(F.col("a")).alias("d")).first()
    assert r["i"] == ["a", "b", "odd"]
    assert r["s"] == ["-I", "-Ib", "-D", "-O2", "-Wall"]
    assert r["d"] == ["-I:a", "-Ib", "-D:X", "-Iodd"]


def test_missing_headers_and_nodes(spark):
    rows = spark.createDataFrame([("x.c:1: fatal error: foo/bar.h: No such file or directory",), ("undefined reference",), ("client: exec on 10.0.0.1:3632: g++",), ("exec on localhost: g++",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(C.is_header_missing(F.col("t")), C.missing_header(F.col("t")), C.exec_node(F.col("t"))).collect()] == [(True, "foo/bar.h", None), (False, None, None), (False, None, "10.0.0.1:3632"), (False, None, "local"), (None, None, None)]


def test_generators_and_classes(spark):
    names = spark.createDataFrame([("a.pb.cc",), ("moc_win.cpp",), ("ui_main.h",), ("g.tab.c",), ("main.cpp",)], "n string")
    assert [r[0] for r in names.select(C.infer_generator(F.col("n"))).collect()] == ["gen:protoc:a.proto", "gen:moc:win.h", "gen:uic:main.ui", "gen:bison:g.y", None]
    assert [r[0] for r in names.select(C.is_generated("n")).collect()] == [True, True, True, True, False]


def test_waits_take_the_last_schedule(spark):
    e = spark.createDataFrame([(1, 0, "scheduled", 1.0), (1, 1, "scheduled", 4.0), (1, 2, "started", 6.5), (2, 3, "started", 9.0)], "task int, n int, kind string, sec double")
    assert _rows(joins.queue_waits(e, ["task"], ["sec", "n"]), "task", "wait") == [(1, 2.5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.d").write_text("out/a.o: src/a.c \\\n  /usr/include/x.h inc/b.h\nout/b.o: src/b.c\n")
    assert _rows(readers.read_dep_files(spark, str(tmp_path / "a.d")), "target", "dependency") == [("out/a.o", "inc/b.h"), ("out/a.o", "src/a.c"), ("out/b.o", "src/b.c")]
    (tmp_path / "hosts").write_text("# all\nh1:4000/8,lzo h2/4\nh3\n\n")
    hosts = readers.read_hosts(spark, str(tmp_path / "hosts"))
    assert _rows(hosts, "host", "port", "slots") == [("h1", 4000, 8), ("h2", 3632, 4), ("h3", 3632, None)]
    assert readers.cluster_capacity(hosts).first()[0] == 13
    (tmp_path / "Makefile").write_text("a: b c\n\tcc\na: d\nX := 1\n")
    assert [tuple(r) for r in readers.read_makefile_rules(spark, str(tmp_path / "Makefile")).collect()] == [("a", ["d"])]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "rr_run1_time.txt").write_text("12.5\n")
    (runs / "rr_run1_distribution.json").write_text('{"distribution": {"n1": 3, "n2": 4}, "total_tasks": 7}')
    (runs / "rr_run2_time.txt").write_text("11\n")
    assert [tuple(r) for r in readers.read_run_results(spark, str(runs)).collect()] == [("rr", 1, 12.5, {"n1": 3, "n2": 4}, 7)]
    (tmp_path / "page").write_text("<stats>\naccepted 12\ncompiles1 3\n</stats>\n")
    assert tuple(readers.read_stats_page(spark, str(tmp_path / "page"), ["accepted", "none"]).first()) == (12.0, None)
    (tmp_path / "table.md").write_text("| n | a |\n|---|---|\n| 1 | b | c | d | e | f | g | h | ✓ |\n| 2 | b | c | d | e | f | g | h | x |\n")
    assert [r["success"] for r in readers.read_task_order_table(spark, str(tmp_path / "table.md")).collect()] == [True, False]
