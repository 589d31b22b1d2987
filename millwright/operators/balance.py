"""How evenly work is spread, and how runs compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.ordered import value_at, value_ranks


def balance_metrics(counts: DataFrame, keys: list[str], value: str = "tasks") -> DataFrame:
    """Of the counts of each group's nodes: total, nodes, mean, sample deviation (0 of one), its percentage of the mean, and extremes."""
    sd, mean = F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value)
    return counts.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count("*").alias("nodes"), F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("std"), F.round(F.when(mean > 0, sd / mean * 100).otherwise(0.0), 4).alias("cv"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("range")
    )


def gini_terms(counts: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Running sum of the counts in ascending order."""
    return counts.withColumn("running", F.sum(value).over(Window.partitionBy(*keys).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)))


def gini(counts: DataFrame, keys: list[str], value: str = "tasks", tie: str = "node") -> DataFrame:
    n = F.count("*")
    total = F.sum(value)
    return gini_terms(counts, keys, value, tie).groupBy(*keys).agg(F.round(F.when(total > 0, (n + 1 - 2 * F.sum("running") / total) / n).otherwise(0.0), 6).alias("gini"))


def run_summary(runs: DataFrame) -> DataFrame:
    """By algorithm over its runs: mean, deviation and extremes of the time, and the mean imbalance of the runs."""
    per_run = runs.groupBy("algo", "run").agg(F.sum("elapsed").alias("elapsed"), (F.coalesce(F.stddev_samp("tasks"), F.lit(0.0)) / F.avg("tasks") * 100).alias("cv"))
    return per_run.groupBy("algo").agg(F.count("*").alias("runs"), F.round(F.avg("elapsed"), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp("elapsed"), F.lit(0.0)), 2).alias("std"), F.round(F.min("elapsed"), 2).alias("least"), F.round(F.max("elapsed"), 2).alias("most"), F.round(F.avg("cv"), 4).alias("mean_cv"))


def baseline_speedup(totals: DataFrame, key: str, value: str, baseline) -> DataFrame:
    """Each row's value against the baseline row's."""
    base = totals.filter(F.col(key) == baseline).select(F.col(value).alias("base")).limit(1)
    return totals.crossJoin(F.broadcast(base)).select(key, F.round(F.col(value), 2).alias(value), F.round(F.when(F.col(value) > 0, F.col("base") / F.col(value)).otherwise(0.0), 6).alias("speedup"))


def compare_runs_per_file(times: DataFrame, a: str, b: str) -> DataFrame:
    """Files in both runs, with both times and how many times slower b is."""
    left = times.filter(F.col("backend") == a).select("file", F.col("seconds").alias("a_seconds"))
    right = times.filter(F.col("backend") == b).select("file", F.col("seconds").alias("b_seconds"))
    return left.join(right, "file").withColumn("speedup", F.round(F.when(F.col("a_seconds") > 0, F.col("b_seconds") / F.col("a_seconds")).otherwise(0.0), 6))


def compare_distribution(counts: DataFrame, key: str, a, b, node: str = "node", value: str = "tasks") -> DataFrame:
    """Counts of two groups by node, missing ones as 0, and their difference."""
    left = counts.filter(F.col(key) == a).groupBy(node).agg(F.sum(value).alias("a"))
    right = counts.filter(F.col(key) == b).groupBy(node).agg(F.sum(value).alias("b"))
    both = left.join(right, node, "full_outer").na.fill(0, ["a", "b"])
    return both.select(node, "a", "b", (F.col("b") - F.col("a")).alias("difference"))


def failures_by_module(failures: DataFrame) -> DataFrame:
    """Failures by mode and module, and over all modes (null mode)."""
    f = failures.filter("failed")
    return f.groupingSets([[F.col("mode"), F.col("module")], [F.col("module")]], "mode", "module").agg(F.count("*").alias("failures"))


def failures_by_file(failures: DataFrame, modes: list[str]) -> DataFrame:
    f = failures.filter("failed")
    return f.groupBy("file").agg(F.count("*").alias("failures"), *[F.count_if(F.col("mode") == m).alias(f"mode_{m}") for m in modes])


def rank_algorithms(totals: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their rank by value, ties sharing one."""
    return totals.select(key, value, F.rank().over(Window.orderBy(value)).alias("rank"))


def assignment_similarity(a: DataFrame, b: DataFrame, key: str, machine: str) -> DataFrame:
    """Share of common tasks that both put on one machine."""
    return a.select(key, F.col(machine).alias("m1")).join(b.select(key, F.col(machine).alias("m2")), key).agg(F.round(F.avg((F.col("m1") == F.col("m2")).cast("double")), 6).alias("similarity"), F.count("*").alias("common"))


def schedule_metrics(schedule: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: makespan, time after the 95th-percentile finish, edges across machines, and deviation of the machines' loads."""
    per = schedule.groupBy("machine").agg(F.sum(F.col("end") - F.col("start")).alias("busy"))
    load = per.agg(F.round(F.stddev_pop("busy"), 4).alias("load_std"))
    n = schedule.agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("makespan"), F.max("end").alias("finish"))
    p95 = value_ranks(schedule, [], "end").agg(value_at("end", F.floor(F.col("size") * 0.95) + 1).alias("p95"))
    place = schedule.select("task_id", "machine")
    crossing = edges.join(place.toDF("src", "m1"), "src").join(place.toDF("dst", "m2"), "dst").filter("m1 <> m2").agg(F.count("*").alias("cross_edges"))
    return n.crossJoin(p95).crossJoin(load).crossJoin(crossing).select("makespan", "p95", (F.col("finish") - F.col("p95")).alias("tail"), "load_std", "cross_edges")
