"""Deep and cyclic graphs against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millwright.operators import graph
from millwright.sources import shared


def longest(vertices, edges, start, cost):
    """Values by visiting producers first; None on cycles or behind them."""
    above = {v: [a for a, b in edges if b == v] for v in vertices}
    value = {}
    changed = True
    while changed:
        changed = False
        for v in vertices:
            if v not in value and all(a in value for a in above[v]):
                value[v], changed = (max(value[a] for a in above[v]) + cost[v] if above[v] else start[v]), True
    return value


def components(vertices, edges):
    """Least vertex of each component with two or more, by reach both ways."""
    reach = {v: {v} for v in vertices}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    own = {v: {w for w in reach[v] if v in reach[w]} for v in vertices}
    return {v: min(c) for v, c in own.items() if len(c) > 1}


def tables(spark, graphs):
    v = spark.createDataFrame([(g, i, kind, w) for g, (vs, _) in graphs.items() for i, kind, w in vs], "graph_id long, id long, node_type string, weight long")
    e = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "graph_id long, src long, dst long")
    return v, e


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    known = shared.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, **k: rounds.append(1) or known(df, **k))
    v = spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), "id", F.lit("compile").alias("node_type"), F.lit(2).cast("long").alias("weight"))
    e = spark.range(n - 1).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    levels = graph.topological_levels(v, e)
    assert levels.filter("level <> id").isEmpty() and levels.count() == n
    assert len(rounds) < 40


def test_levels_and_ranks_of_made_up_graphs(spark):
    rng = random.Random(4)
    graphs = {}
    for g in range(5):
        n = 40
        edges = {(rng.randrange(max(0, b - 6), b), b) for b in range(1, n) for _ in range(rng.choice((0, 1, 1, 2)))}
        if g > 2:
            edges |= {(30, 22), (22, 30), (7, 5), (5, 6), (6, 7)}
        graphs[g] = [(i, rng.choice(("compile", "link", "gen")), rng.randrange(1, 9)) for i in range(n)], sorted(edges)
    v, e = tables(spark, graphs)
    levels = {(r["graph_id"], r["id"]): r["level"] for r in graph.topological_levels(v, e).collect()}
    ranks = {(r["graph_id"], r["id"]): r["rank"] for r in graph.upward_rank(v, e, comm=3).collect()}
    for g, (vs, es) in graphs.items():
        ids, weight = [i for i, _, _ in vs], {i: w for i, _, w in vs}
        assert {i: x for (h, i), x in levels.items() if h == g} == longest(ids, es, dict.fromkeys(ids, 0), dict.fromkeys(ids, 1))
        assert {i: x for (h, i), x in ranks.items() if h == g} == longest(ids, [(b, a) for a, b in es], weight, {i: w + 3 for i, w in weight.items()})


def test_components_and_repair(spark):
    rng = random.Random(5)
    graphs = {g: ([(i, "compile", 1) for i in range(15)], sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(18)})) for g in range(3)}
    v, e = tables(spark, graphs)
    found = {(r["graph_id"], r["id"]): r["component"] for r in graph.strong_components(e).collect()}
    for g, (vs, es) in graphs.items():
        assert {i: c for (h, i), c in found.items() if h == g} == components([i for i, _, _ in vs], es)
    kept = graph.repair_cycles(v, e)
    left = {g: [(r["src"], r["dst"]) for r in kept.filter(f"graph_id = {g}").collect()] for g in graphs}
    for g, (vs, es) in graphs.items():
        assert not components([i for i, _, _ in vs], left[g]) and set(left[g]) <= set(es)
    firm = graph.repair_cycles(v, e.withColumn("relation", F.lit("source")))
    assert firm.count() == e.filter("src <> dst").distinct().count() and firm.filter("refused").count() > 0
    mixed = spark.createDataFrame([(0, 1, 2, "source"), (0, 2, 1, "inferred"), (0, 3, 4, "source"), (0, 4, 3, "source")], "graph_id long, src long, dst long, relation string")
    rows = {(r["src"], r["dst"]): r["refused"] for r in graph.repair_cycles(v, mixed).collect()}
    assert rows == {(1, 2): False, (3, 4): True, (4, 3): True}
