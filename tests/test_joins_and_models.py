"""Includes over search folders, rank selection, models, rebuild reasons and the log table function, on small tables."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from millwright.functions import udtf
from millwright.functions.columns import session_event
from millwright.operators import joins, models, nodes, reports


def test_includes_follow_the_order_of_search_folders(spark):
    text = '#include "a.h"\n#include <a.h>\n#include "sub/b.h"\n#include "own.h"\n#include "far.h"\n#include "sub/none.h"\n#include "none.h"\n'
    src = [(1, "/p/src/x.c", text, ["/inc/one", "/inc/two"]), (2, "/p/src/y.c", text, ["/inc/two", "/inc/one"]), (3, "/p/src/z.c", '#include "a.h"\n', ["/inc/on"]), (4, "/p/src/w.c", None, None)]
    paths = ["/inc/one/a.h", "/inc/two/a.h", "/inc/two/sub/b.h", "/inc/one/deep/sub/b.h", "/p/src/inner/own.h", "/inc/one/own.h", "/else/far.h", "/zzz/far.h"]
    found = joins.resolve_includes(spark.createDataFrame(src, "file_id long, path string, text string, search array<string>"), spark.createDataFrame([(p,) for p in paths], "path string"))
    rows = {(r["file_id"], r["n"]): r["target"] for r in found.collect()}
    shared = {2: "/inc/two/sub/b.h", 3: "/p/src/inner/own.h", 4: "/else/far.h", 5: None, 6: None}
    expected = {(1, 0): "/inc/one/a.h", (1, 1): "/inc/one/a.h", (2, 0): "/inc/two/a.h", (2, 1): "/inc/two/a.h", (3, 0): "/inc/one/a.h"}
    assert rows == expected | {(i, n): t for i in (1, 2) for n, t in shared.items()}


def test_places_of_values(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice((rng.random(), 0.5, None))) for k in (1, 2, 3) for _ in range(10 ** k)]
    found = {r["k"]: r for r in reports.metric_percentiles(spark.createDataFrame(rows, "k long, x double"), ["k"], "x").collect()}
    trimmed = {r["k"]: r["trimmed_mean"] for r in reports.trimmed_mean(spark.createDataFrame(rows, "k long, x double"), ["k"], "x").collect()}
    for k in (1, 2, 3):
        x = sorted(v for j, v in rows if j == k and v is not None)
        assert found[k]["n"] == len(x) and abs(found[k]["median"] - np.median(x)) < 1e-4
        for p in (90, 95, 99):
            assert found[k][f"p{p}"] == round(x[round(p / 100 * (len(x) - 1))], 4)
        cut = int(len(x) * 0.1) if len(x) > 2 else 0
        assert abs(trimmed[k] - np.mean(x[cut : len(x) - cut])) < 1e-4


def test_models_of_four_features(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), *map(float, rng.normal(size=4)), i) for k in (1, 2) for i in range(130)] + [(3, 1.0, 1.0, 1.0, 1.0, 0)] * 2
    rows = [(*r[:5], float(3 * r[1] - r[2] + 0.5 * r[3] + 2 + rng.normal()), r[5]) for r in rows]
    found = {r["k"]: r for r in models.fit_compile_model(spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double, i long"), "k", ["a", "b", "c", "d"], "y", ["i"]).collect()}
    assert found.keys() == {1, 2}
    for k in (1, 2):
        part = np.array([r[1:6] for r in rows if r[0] == k])[:100]
        x, y, w = part[:, :4], part[:, 4], 1 - 0.01 * np.arange(100)
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + 0.01 * np.eye(4), x.T @ (w * y))
        assert np.allclose(found[k]["coefficients"], beta) and np.isclose(found[k]["bias"], (w * (y - x @ beta)).sum() / w.sum()) and found[k]["n"] == 100


def test_reasons_to_build_again(spark):
    now = spark.createDataFrame([(1, 5, 9, "h"), (2, 5, 9, "h"), (3, 6, 9, "h"), (4, 5, 9, "x"), (5, None, 9, "h"), (6, 5, 9, "h")], "id long, mtime long, size long, hash string")
    old = spark.createDataFrame([(1, 5, 9, "h"), (3, 5, 9, "h"), (4, 5, 9, "h"), (5, None, 8, "h"), (6, None, 9, "h"), (7, 5, 9, "h")], "id long, mtime long, size long, hash string")
    found = {r["id"]: r["reason"] for r in joins.needs_rebuild(now, old, ["id"]).collect()}
    assert found == {1: None, 2: "new", 3: "mtime", 4: "hash", 5: "size", 6: "mtime", 7: "gone"}


def test_log_table_function_says_what_patterns_say(spark):
    lines = ["x Task ccdb_7 failed: ", "Task ccdb_8 failed: exit 3", "Task ccdb_1 started on node 10.0.0.1", "Scheduled task ccdb_2 to node 10.0.0.2", "Task ccdb_3 scheduled for execution", "nothing", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string")
    whole = df.select("i", *[c.alias(n) for n, c in session_event(F.col("line")).items()]).filter("kind is not null")
    assert sorted(map(tuple, udtf.parse_log(df).drop("line").collect())) == sorted(map(tuple, whole.collect()))


def test_rankings_say_how_sure_they_are(spark):
    rows = [(1, 4, 1.0, 10, 0, 2, 0.5, 2.0, 1.0, 1.0), (2, 4, 1.0, 10, 0, 1, 0.25, 0.0, 1.0, 0.8), (3, 4, 1.0, 10, 0, 0, 0.0, 4.0, 1.0, 1.0), (4, 4, 1.0, 10, 0, 4, 1.0, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "node_id long, slots int, weight double, latency_ms long, cpu long, load long, load_ratio double, avg_seconds double, success double, performance double")
    least = [tuple(r) for r in nodes.rank_nodes(p, "least_loaded").collect()]
    assert [(r[0], r[1]) for r in least] == [(3, 1), (2, 2), (1, 3)] and {r[3] for r in least} == {0.5}
    fast = [tuple(r) for r in nodes.rank_nodes(p, "fastest").collect()]
    assert [r[0] for r in fast] == [2, 1, 3] and {r[3] for r in fast} == {1.0}
