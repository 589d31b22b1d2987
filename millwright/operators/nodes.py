"""Scores and rankings of nodes, and sets of edges and nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import performance_score

#: Nodes nearer than this get a bonus for locality.
NEAR_MS = 100
_SCORES: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {}


def _over_mean() -> Column:
    """The best score over the mean of all, 1 at most."""
    return F.least(F.lit(1.0), F.when(F.avg("score") > 0, F.max("score") / F.avg("score")).otherwise(1.0))


def register_score(name: str, score: Callable[[], Column], confidence: Callable[[], Column] = _over_mean) -> None:
    """Names a score, a function that gives a Column over a profile's columns, the greater the better; and how sure a choice by it is, an aggregate over the available nodes and their scores."""
    _SCORES[name] = score, confidence


def unregister_score(name: str) -> None:
    _SCORES.pop(name, None)


def list_scores() -> list[str]:
    return sorted(_SCORES)


def _slowest() -> Column:
    """The greatest mean of the nodes at hand; nodes are a dimension table."""
    return F.max("avg_seconds").over(Window.partitionBy(F.lit(1)))


register_score("least_loaded", lambda: -F.col("load_ratio"), lambda: 1 - F.least(F.max("load_ratio") - F.min("load_ratio"), F.lit(0.5)))
register_score("fastest", lambda: F.when(F.col("avg_seconds") > 0, 1 / (1 + F.col("avg_seconds"))).otherwise(F.col("performance")))
register_score("weighted", lambda: 0.4 * (1 - F.col("load_ratio")) + 0.4 * F.when(F.col("avg_seconds") > 0, 1 - F.col("avg_seconds") / _slowest()).otherwise(F.col("performance")) + 0.2 * F.col("success"))
register_score("locality", lambda: 0.5 * F.greatest(F.lit(0.0), 1 - F.col("latency_ms") / 1000) + 0.3 * (1 - F.col("load_ratio")) + 0.2 * F.col("performance") + F.when(F.col("latency_ms") < NEAR_MS, 0.2).otherwise(0.0), lambda: F.lit(0.8))


def node_profile(nodes: DataFrame, tasks: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each node: its latest load over its slots, mean seconds of successes, success rate, performance score."""
    load = samples.groupBy("node_id").agg(F.max_by(F.struct("load", "cpu"), F.struct("at", "sample_id")).alias("x")).select("node_id", "x.load", "x.cpu")
    ok = F.col("status") == "completed"
    past = tasks.groupBy("node_id").agg(F.avg(F.when(ok, F.col("exec_seconds"))).alias("avg_seconds"), F.avg(ok.cast("double")).alias("success"))
    n = nodes.join(load, "node_id", "left").join(past, "node_id", "left")
    p = n.select("node_id", "slots", "weight", "latency_ms", F.coalesce("cpu", F.lit(0)).alias("cpu"), F.coalesce("load", F.lit(0)).alias("load"), (F.coalesce("load", F.lit(0)) / F.col("slots")).alias("load_ratio"), F.coalesce("avg_seconds", F.lit(0.0)).alias("avg_seconds"), F.coalesce("success", F.lit(1.0)).alias("success"))
    return p.withColumn("performance", performance_score(F.col("weight"), F.col("cpu"), F.col("load_ratio"), F.col("success"), F.col("latency_ms")))


def available_nodes(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("load") < F.col("slots"))


def rank_nodes(profile: DataFrame, score: str, *, top: int = 4) -> DataFrame:
    """The best available nodes by a registered score, ties by id: the choice (place 1) and its alternatives, and how sure the choice is."""
    value, confidence = _SCORES[score]
    scored = available_nodes(profile).withColumn("score", F.round(value(), 6))
    best = scored.select("node_id", "score").orderBy(F.col("score").desc(), "node_id").limit(top)
    sure = scored.agg(F.round(confidence(), 6).alias("confidence"))  # one row
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "node_id"))).crossJoin(F.broadcast(sure)).select("node_id", "place", "score", "confidence")


def combine_modes(parts: list[DataFrame]) -> DataFrame:
    """Failure counts of several runs as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file").agg(F.sum("failures").alias("failures"))


def common_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def edge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct edges two graphs share, and how many either has (1 at least)."""
    edges = a.distinct().withColumn("n", F.lit(1)).unionByName(b.distinct().withColumn("n", F.lit(1))).groupBy(*a.columns).agg(F.sum("n").alias("n"))
    return edges.agg(F.count_if(F.col("n") == 2).alias("overlap"), F.greatest(F.count("*"), F.lit(1).cast("long")).alias("union"))


def set_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common rows over all distinct rows, 1 where both are empty; both counts alongside."""
    both = a.distinct().withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.distinct().withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    rows = both.groupBy(*a.columns).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    shared, union = F.count_if((F.col("a") == 1) & (F.col("b") == 1)), F.count("*")
    return rows.agg(shared.alias("common"), union.alias("all"), F.round(F.when(union == 0, 1.0).otherwise(shared / union), 6).alias("jaccard"))


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges in only one of the two, and in which."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def top_diff_edges(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    d = edge_diff(a, b)
    return d.orderBy(*d.columns).limit(k)


def removed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.subtract(after)


def heavy_tasks(files: DataFrame, value: str, least: float) -> DataFrame:
    """Every file with whether it is heavy."""
    return files.withColumn("heavy", F.col(value) >= least)


def heavy_coverage(flagged: DataFrame, value: str) -> DataFrame:
    heavy = F.col("heavy").cast("double")
    return flagged.agg(F.round(F.avg(heavy) * 100, 4).alias("heavy_percent"), F.round(F.sum(F.col(value) * heavy) / F.sum(value), 6).alias("heavy_share"))


def top_by(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in that order; ties are for the order to settle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def link_markers(objects: DataFrame, *, whole: int = 64, marks: int = 10) -> DataFrame:
    """All of a graph's few objects, else its first and last by id."""
    w = Window.partitionBy("graph_id")
    n, up, down = F.count("*").over(w), F.row_number().over(w.orderBy("id")), F.row_number().over(w.orderBy(F.col("id").desc()))
    r = objects.withColumn("n", n).withColumn("up", up).withColumn("down", down)
    return r.filter((F.col("n") <= whole) | (F.col("up") <= marks // 2) | (F.col("down") <= marks // 2)).select(*objects.columns)
