"""Summaries of tasks, decisions, nodes, builds and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import hour_bucket, seconds_between, task_durations
from millwright.operators.ordered import join_groups, median, value_at, value_ranks


def with_durations(tasks: DataFrame) -> DataFrame:
    return tasks.select("*", *task_durations())


def _percent(hit: Column, digits: int = 4) -> Column:
    """Share of rows in percent; 0 of none."""
    return F.round(F.coalesce(F.avg(hit.cast("double")) * 100, F.lit(0.0)), digits)


def task_summary(tasks: DataFrame) -> DataFrame:
    """One row: counts, success rate, mean queue and execution seconds, completed tasks an hour."""
    t = with_durations(tasks)
    span = (F.max(F.unix_micros("completed_at")) - F.min(F.unix_micros("completed_at"))) / 3_600_000_000
    done = F.count_if(F.col("status") == "completed")
    return t.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        _percent(F.col("status") == "completed").alias("success_percent"),
        F.round(F.avg("queue_seconds"), 4).alias("avg_queue"),
        F.round(F.avg("exec_seconds"), 4).alias("avg_exec"),
        F.round(F.when(span > 0, done / span).otherwise(0.0), 4).alias("per_hour"),
    )


def algorithm_performance(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("algorithm").agg(F.count("*").alias("tasks"), _percent(F.col("status") == "completed").alias("success_percent"))


def node_summary(tasks: DataFrame) -> DataFrame:
    t = with_durations(tasks.filter("node_id is not null"))
    return t.groupBy("node_id").agg(F.count("*").alias("tasks"), _percent(F.col("status") == "completed").alias("success_percent"), F.round(F.avg("exec_seconds"), 4).alias("avg_exec"))


def hourly_distribution(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(hour_bucket("created_at").alias("hour")).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), _percent(F.col("status") == "completed").alias("completed_percent"))


def performance_trend(tasks: DataFrame, metric: str) -> DataFrame:
    """(hour, value) of throughput, success_rate or exec_time; no rows for another name."""
    if metric == "throughput":
        return tasks.groupBy(hour_bucket("created_at").alias("hour")).agg(F.count("*").cast("double").alias("value"))
    if metric == "success_rate":
        return tasks.groupBy(hour_bucket("created_at").alias("hour")).agg(_percent(F.col("status") == "completed").alias("value"))
    found = with_durations(tasks).groupBy(hour_bucket("completed_at").alias("hour")).agg(F.round(F.avg("exec_seconds"), 4).alias("value"))
    return found if metric == "exec_time" else found.limit(0)


def decision_usage(decisions: DataFrame) -> DataFrame:
    """Decisions by algorithm and by node, in one pass."""
    sets = [[F.col("algorithm")], [F.col("node_id")]]
    return decisions.groupingSets(sets, "algorithm", "node_id").agg(F.count("*").alias("decisions"))


def metric_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (90, 95, 99)) -> DataFrame:
    """count, mean, median and percentiles by nearest rank with half-even rounding."""
    size = F.col("size")
    at = [F.round(value_at(value, F.bround(F.lit(p / 100) * (size - 1), 0) + 1), 4).alias(f"p{p}") for p in percents]
    middle = (value_at(value, F.floor((size + 1) / 2)) + value_at(value, F.floor(size / 2) + 1)) / 2
    picked = value_ranks(df, keys, value).groupBy(*keys).agg(F.round(middle, 4).alias("median"), *at)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return join_groups(counts, picked, keys)


def quantile_summary(df: DataFrame, keys: list[str], value: str, ok: Column) -> DataFrame:
    """Totals, and mean, exclusive 95th percentile (the greatest of fewer than 20) and maximum of the successes."""
    spot = 19 * (F.col("size") + 1) / 20
    low = F.floor(spot)
    a, b, part = value_at(value, low), value_at(value, low + 1), F.max(spot - low)
    p95 = F.when(F.max("size") >= 20, a + part * (F.coalesce(b, a) - a)).otherwise(F.max(value))
    picked = value_ranks(df.filter(ok), keys, value).groupBy(*keys).agg(F.round(p95, 4).alias("p95"))
    good = F.when(ok, F.col(value))
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.round(F.avg(good), 4).alias("mean"), F.round(F.max(good), 4).alias("longest"))
    return join_groups(totals, picked, keys, "left").select(*keys, "total", "success", "failed", "mean", "p95", "longest")


def queue_stats(tasks: DataFrame) -> DataFrame:
    """Tasks by status, and all of them as "total"."""
    return tasks.rollup("status").agg(F.count("*").alias("tasks")).withColumn("status", F.coalesce("status", F.lit("total")))


def cluster_stats(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """One row about the cluster, from each node's latest sample: nodes, slots, use, and means over nodes with room."""
    latest = samples.groupBy("node_id").agg(F.max_by(F.struct("cpu", "memory", "load"), F.struct("at", "sample_id")).alias("x")).select("node_id", "x.*")
    n = nodes.join(latest, "node_id", "left")
    free = F.col("load") < F.col("slots")
    return n.agg(
        F.count("*").alias("nodes"),
        F.count("load").alias("online"),
        F.count_if(free).alias("available"),
        F.sum("slots").cast("long").alias("slots"),
        F.coalesce(F.sum("load"), F.lit(0)).alias("used"),
        F.round(F.coalesce(F.sum("load"), F.lit(0)) / F.sum("slots") * 100, 4).alias("used_percent"),
        F.round(F.avg("cpu"), 4).alias("avg_cpu"),
        F.round(F.avg("memory"), 4).alias("avg_memory"),
    )


def build_summary(tasks: DataFrame) -> DataFrame:
    """By build: wall seconds, summed execution seconds and their ratio, and whether all went well."""
    t = with_durations(tasks)
    wall = (F.max(F.unix_micros("completed_at")) - F.min(F.unix_micros("started_at"))) / 1_000_000
    return t.groupBy("build_id").agg(
        F.round(wall, 4).alias("wall"),
        F.round(F.sum("exec_seconds"), 2).alias("exec_sum"),
        F.round(F.when(wall > 0, F.sum("exec_seconds") / wall).otherwise(0.0), 4).alias("parallelism"),
        F.count_if(F.col("status") == "completed").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.count_if(F.col("status") == "failed") == 0).alias("success"),
    )


def benchmark_summary(tasks: DataFrame, key: str) -> DataFrame:
    t = with_durations(tasks)
    wall = (F.max(F.unix_micros("completed_at")) - F.min(F.unix_micros("started_at"))) / 1_000_000
    return t.groupBy(key).agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        _percent(F.col("status") == "completed").alias("rate"),
        *[F.round(f("exec_seconds"), 4).alias(n) for n, f in (("avg_exec", F.avg), ("max_exec", F.max), ("min_exec", F.min))],
        F.round(F.count("*") / wall, 6).alias("per_second"),
    )


def benchmark_matrix(tasks: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row for each ``row``, a column of counts for each named value of ``column``."""
    return tasks.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def parallel_metrics(tasks: DataFrame) -> DataFrame:
    """By build: ideal seconds (the sum over the nodes), what lies above it, use, and the slowest node against the mean."""
    t = with_durations(tasks)
    per_node = t.groupBy("build_id", "node_id").agg(F.sum("exec_seconds").alias("busy"), F.min(F.unix_micros("started_at")).alias("a"), F.max(F.unix_micros("completed_at")).alias("b"))
    wall = (F.max("b") - F.min("a")) / 1_000_000
    ideal = F.sum("busy") / F.count("*")
    return per_node.groupBy("build_id").agg(F.count("*").alias("nodes"), F.round(ideal, 4).alias("ideal"), F.round(wall - ideal, 4).alias("overhead"), F.round(ideal / wall * 100, 4).alias("used_percent"), F.round(F.max("busy") / F.avg("busy"), 4).alias("bottleneck"))


def cost_analysis(tasks: DataFrame, *, node_price: float = 0.5, single_price: float = 2.0) -> DataFrame:
    """By build: price of the nodes for the wall time against one machine for the summed time, and what is saved."""
    t = with_durations(tasks)
    wall_h = (F.max(F.unix_micros("completed_at")) - F.min(F.unix_micros("started_at"))) / 3_600_000_000
    cost, single = wall_h * F.count_distinct("node_id") * node_price, F.sum("exec_seconds") / 3600 * single_price
    return t.groupBy("build_id").agg(F.round(cost, 4).alias("distributed"), F.round(single, 4).alias("single"), F.round((single - cost) / single * 100, 4).alias("saved_percent"))


def event_counters(stats: DataFrame) -> DataFrame:
    return stats.groupBy("kind").agg(F.count("*").alias("events"))


def longest_job(stats: DataFrame) -> DataFrame:
    """The job that took longest, of all that ran; of equals the first."""
    return stats.agg(F.max_by(F.struct("file", "kind", "seconds"), F.struct("seconds", -F.col("id"))).alias("x")).select("x.file", "x.kind", "x.seconds")


def algorithm_score(tasks: DataFrame) -> DataFrame:
    """0.7 success rate and 0.3 of 1 / (1 + mean seconds of successes), and each algorithm's share of the scores."""
    t = with_durations(tasks)
    ok = F.col("status") == "completed"
    s = t.groupBy("algorithm").agg(F.avg(ok.cast("double")).alias("rate"), F.avg(F.when(ok, F.col("exec_seconds"))).alias("seconds"))
    s = s.select("algorithm", F.coalesce(0.7 * F.col("rate") + 0.3 / (1 + F.col("seconds")), F.lit(0.5)).alias("score"))
    total = s.agg(F.sum("score").alias("all_scores"))  # a row
    return s.crossJoin(F.broadcast(total)).select("algorithm", F.round("score", 6).alias("score"), F.round(F.col("score") / F.col("all_scores"), 6).alias("share"))


def robust_estimate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation; a group without a known value has no row."""
    middle = median(df, keys, value)
    off = join_groups(df, middle, keys).withColumn("__off", F.abs(F.col(value) - F.col("median")))
    both = join_groups(middle, median(off, keys, "__off", "mad"), keys)
    return both.select(*keys, F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean without that share of rows at either end; all rows of a group of fewer than three."""
    cut = F.when(F.col("size") < 3, 0).otherwise(F.floor(F.col("size") * share))
    kept = F.greatest(F.lit(0), F.least(F.col("before") + F.col("n"), F.col("size") - cut) - F.greatest(F.col("before"), cut))
    return value_ranks(df, keys, value).withColumn("kept", kept).filter("kept > 0").groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col("kept")) / F.sum("kept"), 4).alias("trimmed_mean"))


def time_cv(df: DataFrame, keys: list[str], value: str, *, least: int = 3, unstable: float = 0.3) -> DataFrame:
    """Population deviation over mean where there are samples enough, and whether that is unstable."""
    cv = F.col("sd") / F.col("mean")
    return df.groupBy(*keys).agg(F.count(value).alias("samples"), F.stddev_pop(value).alias("sd"), F.avg(value).alias("mean")).filter((F.col("samples") >= least) & (F.col("mean") > 0)).select(*keys, "samples", F.round(cv, 6).alias("cv"), (cv > unstable).alias("unstable"))


def recommendations(metrics: DataFrame) -> DataFrame:
    """A row of advice for every threshold that a build's success_percent, cv or used_percent crosses."""
    rules = (("low_success", F.col("success_percent") < 60), ("imbalance", F.col("cv") > 60), ("idle", F.col("used_percent") < 50))
    advice = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda a: a.isNotNull())
    return metrics.select("build_id", F.explode(advice).alias("advice"))


def task_busy_seconds(tasks: DataFrame) -> DataFrame:
    return tasks.select("node_id", seconds_between("started_at", "completed_at").alias("seconds"))


def compare_summary(metrics: DataFrame, key: str, a, b, columns: list[str]) -> DataFrame:
    """By how many percent each metric of ``b`` lies below ``a``'s."""
    one = lambda k, tag: metrics.filter(F.col(key) == k).agg(*[F.max(c).alias(f"{c}_{tag}") for c in columns])
    both = one(a, "a").crossJoin(one(b, "b"))  # a row and a row
    return both.select(*[F.round(F.when(F.col(f"{c}_a") != 0, (F.col(f"{c}_a") - F.col(f"{c}_b")) / F.col(f"{c}_a") * 100).otherwise(0.0), 4).alias(c) for c in columns])


def schedule_score(metrics: DataFrame) -> DataFrame:
    """Makespan, a tenth of the loads' variance and a twentieth of the edges between machines; the less the better."""
    return metrics.select(F.round(F.col("makespan") + 0.1 * F.pow("load_std", F.lit(2)) + 0.05 * F.col("cross_edges"), 2).alias("score"))


def active_monitor_rows(states: DataFrame, now: Column, *, seconds: int = 60, done: str = "done") -> DataFrame:
    """Each process's latest state, unless it is done or old, by host and slot."""
    latest = states.groupBy("host", "slot", "pid").agg(F.max_by("phase", "at").alias("phase"), F.max("at").alias("at"))
    return latest.filter((F.col("phase") != done) & (now - F.col("at") <= seconds)).orderBy("host", "slot", "pid")


def node_tier_util(counts: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tasks of each slot class, and tasks for each of its slots in percent."""
    return counts.join(tiers.select("node_id", "slots"), "node_id").groupBy("slots").agg(F.sum("tasks").alias("tasks"), F.round(F.sum("tasks") / F.sum("slots") * 100, 4).alias("per_slot_percent"))


def preferred_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows in a given order of keys, others after them by key."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1)).orderBy("place", key)


def infer_generated_inputs(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, input) of generated names whose input is among the files."""
    guess = (
        F.when(F.col("name").rlike(r"^moc_.*\.cpp$"), F.regexp_replace("name", r"^moc_(.*)\.cpp$", "$1.h"))
        .when(F.col("name").rlike(r"^ui_.*\.h$"), F.regexp_replace("name", r"^ui_(.*)\.h$", "$1.ui"))
        .when(F.col("name").rlike(r"\.pb\.(cc|h)$"), F.regexp_replace("name", r"\.pb\.(cc|h)$", ".proto"))
        .when(F.col("name") == "config.h", F.lit("config.h.in"))
    )
    return names.withColumn("input", guess).filter("input is not null").join(files.select(F.col("name").alias("input")), "input", "left_semi").select("name", "input")


def stall_and_done(snapshots: DataFrame, *, intervals: int = 10) -> DataFrame:
    """STALLED where started and finished have not changed for that many snapshots, DONE where all is finished and nothing waits or runs."""
    w = Window.partitionBy("build_id").orderBy("n")
    still = (F.col("started") == F.lag("started", intervals).over(w)) & (F.col("finished") == F.lag("finished", intervals).over(w))
    done = (F.col("finished") >= F.col("total")) & (F.col("waiting") == 0)
    return snapshots.withColumn("alert", F.when(done, "DONE").when(still, "STALLED")).filter("alert is not null").select("build_id", "n", "alert")


def merkle_fingerprint(df: DataFrame, keys: list[str], name: str, stamp: str, *, digits: int = 2) -> DataFrame:
    """(keys, files, fingerprint) of named things with a stamp each, by a tree of hashes: each stamp, each part of a group, the group.

    A part holds the names whose hash begins with the same digits, in order; a group has 16 ** digits parts at most, so with
    enough digits no row gathers more than a part's names.
    """
    parted = df.select(*keys, F.substring(F.sha2(name, 256), 1, digits).alias("part"), F.struct(F.col(name).alias("name"), F.sha2(stamp, 256).alias("h")).alias("x"))
    folded = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["h"]), ","), 256)
    parts = parted.groupBy(*keys, "part").agg(F.count("*").alias("n"), folded("x").alias("h"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("files"), folded(F.struct("part", "h")).alias("fingerprint"))
