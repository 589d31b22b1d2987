"""Queries and operators do the whole job, also where their SQL leaves out a part or the tables show no difference."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from millwright.functions import columns as C
from millwright.operators import graph, joins
from millwright.plans import adapters as A
from millwright.plans.queries import QUERIES, _with_odd_edges

#: Tables with more than twelve nodes.
LARGER = "/root/testdata/sf0.01"


def test_every_task_has_a_cost_on_every_node(spark):
    tasks, nodes = A.vertices(spark, LARGER).count(), A.nodes(spark, LARGER).count()
    found = QUERIES["exec_cost_matrix"](spark, LARGER)
    assert nodes > 12 and found.count() == found.select("id", "node_id").distinct().count() == tasks * nodes


def test_cheapest_node_is_sought_among_all(spark):
    names = ["id", "node_id", "cost"]
    cases = [(0, 1.0), (3, 0.5), (5, 1.0), (40, 4.0), (41, 4.0), (77, 2.0)]
    nodes = spark.createDataFrame(cases, "node_id long, weight double")
    tasks = spark.createDataFrame([(1, 8, False), (2, 0, False), (3, 8, True), (4, 0, True)], "id long, time long, cuda boolean")
    whole = joins.exec_cost_matrix(tasks, nodes, F.col("time"), F.col("cuda"))
    some = joins.exec_cost_matrix(tasks, joins.cost_classes(nodes), F.col("time"), F.col("cuda"))
    rows = [sorted(map(tuple, joins.cheapest_node(m, "id").select(*names).collect())) for m in (whole, some)]
    assert rows[0] == rows[1] == [(1, 40, 2.0), (2, 0, 0.0), (3, 0, 8.0), (4, 0, 0.0)]
    best = min((-r["weight"], r["node_id"]) for r in A.nodes(spark, LARGER).collect())
    found = QUERIES["cheapest_node"](spark, LARGER).collect()
    assert len(found) == A.vertices(spark, LARGER).count() and {r["node_id"] for r in found} == {best[1]}


def _reduced(spark, pairs, **guards):
    e = spark.createDataFrame([(0, a, b) for a, b in pairs], "graph_id long, src long, dst long")
    return sorted((r["src"], r["dst"]) for r in graph.transitive_reduction(e, **guards).collect())


def _has_detour(pairs, a, b) -> bool:
    seen, front = set(), {y for x, y in pairs if x == a and y != b}
    while front:
        seen |= front
        front = {y for x, y in pairs if x in front} - seen
    return b in seen


def test_transitive_reduction_finds_detours_of_any_length(spark):
    chain = [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert _reduced(spark, [*chain, (1, 4)]) == chain
    assert _reduced(spark, [*chain, (1, 3), (1, 5), (2, 5)]) == chain
    r = random.Random(5)
    pairs = sorted({(a, b) for a, b in ((r.randrange(18), r.randrange(18)) for _ in range(110)) if a < b})
    assert _reduced(spark, pairs) == [p for p in pairs if not _has_detour(pairs, *p)]
    assert _reduced(spark, [(1, 2), (2, 1), (2, 3)]) == [(1, 2), (2, 1), (2, 3)]


def test_guards_of_transitive_reduction(spark):
    chain, vertices = [(1, 2), (2, 3), (3, 4), (4, 5)], lambda *ids: spark.createDataFrame([(0, k) for k in ids], "graph_id long, id long")
    pairs = sorted([*chain, (1, 3), (1, 4), (1, 5)])
    assert _reduced(spark, pairs, within=vertices(1, 2, 3)) == [p for p in pairs if p != (1, 3)]
    assert _reduced(spark, pairs, critical=vertices(1, 4)) == sorted([*chain, (1, 4)])
    assert _reduced(spark, pairs, share=0.3) == sorted([*chain, (1, 5)])


def test_include_closure_starts_from_every_unit(spark, sf_dir):
    after: dict[int, set[int]] = {}
    for e in A.edges(spark, sf_dir).collect():
        after.setdefault(e["src"], set()).add(e["dst"])
    whole = set()
    for unit in after:
        front, seen = after[unit], set()
        while front:
            seen |= front
            front = set().union(*(after.get(x, set()) for x in front)) - seen
        whole |= {(unit, x) for x in seen}
    assert sorted(map(tuple, QUERIES["include_closure"](spark, sf_dir).select("unit", "id").collect())) == sorted(whole)


def test_all_log_lines_are_read_back(spark, sf_dir):
    lines = lambda df: sorted(r["line"] for r in df.select("line").collect())
    assert lines(QUERIES["read_log_lines"](spark, sf_dir)) == lines(A.log_lines(spark, sf_dir))


def test_repaired_cycles_grow_with_the_table(spark, sf_dir):
    planted = [_with_odd_edges(spark, x)[1].count() - A.edges(spark, x).count() for x in (sf_dir, LARGER, "/root/testdata/sf0.1")]
    assert 1 <= planted[0] < planted[1] / 5 < planted[2] / 25
    assert graph.cyclic_nodes(*_with_odd_edges(spark, sf_dir)).count() >= 2
    edges = lambda df: sorted(map(tuple, df.select("graph_id", "src", "dst").collect()))
    assert edges(QUERIES["repair_cycles"](spark, sf_dir)) == edges(A.edges(spark, sf_dir))


def brute_hash(text: str) -> str:
    raw = text.encode()
    n = len(raw)
    return hashlib.md5(raw if n < 65536 else raw[:4096] + raw[n // 2 : n // 2 + 4096] + raw[-4096:]).hexdigest()


def test_long_texts_have_a_content_hash(spark, tmp_path):
    r = random.Random(12)
    texts = ["".join(r.choices("abcdé 中\n", k=n)) for n in (0, 10, 30_000, 60_000, 150_000)] + ["".join(r.choices("abcd", k=n)) for n in (65_535, 65_536, 65_537, 99_999)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, table.select("doc_id", C.content_hash(F.col("text"))).collect())) == {k: brute_hash(t) for k, t in enumerate(texts)}
    table.withColumns({"lang": F.lit("en"), "source": F.lit("web")}).write.parquet(f"{tmp_path}/documents.parquet")
    sources = {x["file_id"]: x["text"] for x in A.sources(spark, str(tmp_path)).collect()}
    found = dict(map(tuple, QUERIES["content_hash"](spark, str(tmp_path)).select("file_id", "hash").collect()))
    assert found == {k: brute_hash(t) for k, t in sources.items()} and len(found) == len(texts)


def test_streams_fold_all_frames_of_a_node_in_time_order(spark, sf_dir):
    """A node's rows come in several frames once a record batch is full."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = lambda: [sorted(map(tuple, QUERIES[q](spark, sf_dir).collect())) for q in ("stream_ema", "stream_backoff")]
    whole, before = rows(), spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        assert rows() == whole
    finally:
        spark.conf.set(name, before)


def test_local_or_remote_takes_the_least_sum(spark):
    nodes = spark.createDataFrame([(0, 9.0, 0), (1, 2.0, 5000), (2, 1.9, 10), (3, 1.0, 0)], "node_id long, weight double, latency_ms long")
    tasks = spark.createDataFrame([(1, 4.0, False), (2, 0.1, False), (3, 100.0, True)], "id long, est double, cuda boolean")
    side = lambda n: {r["id"]: r["side"] for r in joins.local_or_remote(tasks, n).collect()}
    assert side(nodes) == {1: "remote", 2: "local", 3: "local"}  # a marginally faster but distant node does not decide
    assert set(side(nodes.filter("node_id = 0")).values()) == {"local"}


def test_pruned_graphs_keep_links_and_cycles_are_issues(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 1, 9), (0, 3, 9), (0, 4, 8), (0, 2, 5), (0, 5, 2)], "graph_id long, src long, dst long")
    ids = lambda *x: spark.createDataFrame([(0, k, 1) for k in x], "graph_id long, id long, weight long")
    kept = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    assert kept(graph.prune_graph(e, ids(1, 2), links=ids(8, 9))) == [(1, 2), (1, 9)]
    assert kept(graph.prune_graph(e, ids(1, 2))) == [(1, 2)]
    issues = sorted((r["id"], r["issue"]) for r in graph.validate_graph(ids(1, 2, 3, 4, 5, 7, 8), e).collect())
    assert issues == [(2, "cycle"), (5, "cycle"), (7, "orphan"), (9, "unknown")]
