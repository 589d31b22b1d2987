"""Ordered work per node, task, machine or host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.ordered import in_order

#: Kinds of server events that count as compiles.
COMPILE_KINDS = ("COMPILE_OK", "COMPILE_ERROR", "COMPILE_TIMEOUT", "COMPILE_DISCONN")


def recent_samples(df: DataFrame, keys: list[str], order: list, n: int = 10) -> DataFrame:
    """The newest ``n`` rows of each group."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("recency") <= n)


def rolling_speedup(df: DataFrame, key: str, order: list, estimated: Column, actual: Column, rows: int = 20) -> DataFrame:
    """Mean of estimated over actual time, held between 0.5 and 2, over the last ``rows`` of each group; 1 where nothing was measured."""
    one = F.when(actual > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), estimated / actual))).otherwise(1.0)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("speedup", F.round(F.avg(one).over(w), 6))


def ema_closed_form(df: DataFrame, key: str, order: list, value: str, alpha: float) -> DataFrame:
    """Each group's exponential moving average at its end: the first value weighs (1-a)^(n-1), the i-th a(1-a)^(n-i)."""
    ranked = in_order(df.select(key, *order, value), [key], order).withColumnsRenamed({"__i": "i", "__n": "n"})
    weight = F.when(F.col("i") == 1, F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")))
    return ranked.groupBy(key).agg(F.round(F.sum(weight * F.col(value)), 4).alias("ema"), F.count("*").alias("n"))


def ema_link(transfers: DataFrame, *, alpha: float = 0.3) -> DataFrame:
    """Moving averages of a link's megabytes a second and latency: (link, mb_per_s, latency_ms, n) over (link, day, at, id, bytes, seconds).

    Transfers without bytes or time teach nothing.  Each (link, day) is folded first, so that no task holds a busy link whole.
    """
    used = transfers.filter("seconds > 0 and bytes > 0").withColumn("mb_per_s", F.col("bytes") / 1048576 / F.col("seconds")).withColumn("latency_ms", F.col("seconds") * 1000)
    speed, wait = (ema_by_day(used, "link", "day", ["at", "id"], c, alpha).select("link", F.col("ema").alias(c)) for c in ("mb_per_s", "latency_ms"))
    return speed.join(wait, "link")


def ema_compile_time(tasks: DataFrame) -> DataFrame:
    """Per node over successful tasks in completion order."""
    return ema_closed_form(tasks.filter("status = 'completed'"), "node_id", ["completed_at", "task_id"], "exec_seconds", 0.1)


def ema_by_day(df: DataFrame, key: str, day: str, order: list, value: str, alpha: float) -> DataFrame:
    """As ``ema_closed_form``, folded in two steps: each (group, day) to a weight and a sum, then the days of a group.

    A group's days are few, so no task holds all rows of a busy group.
    """
    w = Window.partitionBy(key, day)
    ranked = df.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    part = ranked.groupBy(key, day).agg(
        F.max("n").alias("n"),
        F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.col(value)).alias("s"),
        F.max(F.when(F.col("i") == 1, F.col(value))).alias("first"),
    )
    days = Window.partitionBy(key)
    later = F.coalesce(F.sum("n").over(days.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opening = F.row_number().over(days.orderBy(day)) == 1
    decay = F.pow(F.lit(1 - alpha), F.col("later"))
    seeded = part.withColumn("later", later).withColumn("opening", opening)
    # the very first value weighs 1 / alpha times what a later one in its place would
    extra = F.when(F.col("opening"), (1 - alpha) * F.pow(F.lit(1 - alpha), F.col("n") - 1) * F.col("first")).otherwise(0.0)
    return seeded.groupBy(key).agg(F.round(F.sum(decay * (F.col("s") + extra)), 4).alias("ema"), F.sum("n").alias("n"))


def running_success_rate(tasks: DataFrame) -> DataFrame:
    """Each task with the share of successes among its node's tasks of known status up to it."""
    known, good = F.col("status").isNotNull(), F.col("status") == "completed"
    counted = in_order(tasks, ["node_id"], ["completed_at", "task_id"], sums={"__known": known.cast("long"), "__good": good.cast("long")})
    return counted.select(*tasks.columns, F.round(F.try_divide("__good", "__known"), 6).alias("rate"))


def forecast_load(samples: DataFrame, nodes: DataFrame, *, last: int = 10, ahead: float = 5.0) -> DataFrame:
    """Least-squares value of the node's last loads, ``ahead`` steps on, held between 0 and its slots, over the slots."""
    recent = recent_samples(samples, ["node_id"], [F.col("at").desc(), F.col("sample_id").desc()], last)
    n = F.count("*").over(Window.partitionBy("node_id"))
    at = recent.withColumn("n", n).withColumn("x", F.col("n") - F.col("recency"))
    line = at.groupBy("node_id").agg(F.max("n").alias("n"), F.regr_slope("load", "x").alias("slope"), F.regr_intercept("load", "x").alias("base"), F.max_by("load", "x").alias("now"))
    value = F.when(F.col("n") < 2, F.col("now")).otherwise(F.col("base") + F.col("slope") * (F.col("n") - 1 + ahead))
    held = F.greatest(F.lit(0.0), F.least(F.col("slots").cast("double"), value))
    return line.join(nodes.select("node_id", "slots"), "node_id").select("node_id", F.round(held / F.col("slots"), 6).alias("forecast"))


def trend_slope(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Least-squares slope of a value over the places of its group's rows."""
    return in_order(df.select(key, *order, value), [key], order).groupBy(key).agg(F.round(F.regr_slope(value, "__i"), 6).alias("slope"))


def idle_gaps(schedule: DataFrame) -> DataFrame:
    """Per machine, the summed time between one interval's end and the next one's start."""
    placed = in_order(schedule.select("machine", "start", "end", "task_id"), ["machine"], ["start", "task_id"], after={"__next": F.col("start")})
    gap = F.greatest(F.col("__next") - F.col("end"), F.lit(0))
    return placed.withColumn("gap", gap).groupBy("machine").agg(F.sum("gap").alias("idle"), F.count("*").alias("intervals"))


def step_numbers(tasks: DataFrame) -> DataFrame:
    """Place of each task in its build, by start."""
    return in_order(tasks, ["build_id"], ["started_at", "task_id"]).withColumnRenamed("__i", "step").drop("__n")


def status_changes(tasks: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows whose status is not that of the row before in the group."""
    placed = in_order(tasks, [key], ["completed_at", "task_id"], before={"before": F.col("status")}).drop("__i", "__n")
    return placed.filter(~F.col("status").eqNullSafe(F.col("before")))


def phase_durations(states: DataFrame, keys: list[str], at: str, order: list) -> DataFrame:
    """Time in each state until the next one; the last has none."""
    return states.withColumn("lasted", F.lead(at).over(Window.partitionBy(*keys).orderBy(*order)) - F.col(at))


def running_compile_totals(stats: DataFrame) -> DataFrame:
    """At each event of a node, how many compiles ended in the last 60, 300 and 900 seconds."""
    spans = (60, 300, 900)
    s = stats.select("id", "node_id", F.floor(F.unix_micros("stopped_at") / 1_000_000).alias("sec"), F.col("kind").isin(*COMPILE_KINDS).cast("int").alias("hit"))
    own = F.floor(F.col("sec") / max(spans))
    # an event is seen from its own stretch of 900 seconds and from the next one, so no task needs more than two stretches of a node
    seen = s.select("*", F.explode(F.when(F.col("sec").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(own, own + 1))).alias("stretch"))
    over = lambda span: Window.partitionBy("node_id", "stretch").orderBy("sec").rangeBetween(1 - span, 0)
    totals = seen.select("id", "node_id", "sec", "stretch", *[F.sum("hit").over(over(span)).alias(f"last_{span}") for span in spans])
    return totals.filter(F.col("stretch").eqNullSafe(own)).drop("sec", "stretch")


def minute_load_averages(stats: DataFrame) -> DataFrame:
    """Per node and minute with a job: jobs that began in it, and means over the last 5 and 15 such minutes."""
    m = stats.groupBy("node_id", F.floor(F.unix_micros("started_at") / 60_000_000).alias("minute")).agg(F.count("*").alias("load"))
    over = lambda k: Window.partitionBy("node_id").orderBy("minute").rowsBetween(1 - k, 0)
    return m.select("node_id", "minute", "load", *[F.round(F.avg("load").over(over(k)), 6).alias(f"mean_{k}") for k in (5, 15)])


def adaptive_window(decisions: DataFrame, *, size: int = 60, least: int = 20) -> DataFrame:
    """The newest decisions of each node, where there are enough of them."""
    w = Window.partitionBy("node_id")
    d = decisions.withColumn("recency", F.row_number().over(w.orderBy(F.col("decided_at").desc(), F.col("task_id").desc(), F.col("attempt").desc()))).withColumn("total", F.count("*").over(w))
    return d.filter((F.col("recency") <= size) & (F.col("total") >= least))


def small_task_batches(schedule: DataFrame, edges: DataFrame, *, share: float = 0.3, size: int = 5) -> DataFrame:
    """Tasks shorter than a share of their machine's mean, with no edge on it, in batches of ``size``; batches of one are left out."""
    own = schedule.withColumn("length", F.col("end") - F.col("start"))
    small = own.withColumn("mean", F.avg("length").over(Window.partitionBy("machine"))).filter(F.col("length") < share * F.col("mean"))
    place = schedule.select("task_id", "machine")
    e = edges.join(place.toDF("src", "m1"), "src").join(place.toDF("dst", "m2"), "dst").filter("m1 = m2")
    tied = e.select(F.explode(F.array("src", "dst")).alias("task_id")).distinct()
    free = small.join(tied, "task_id", "left_anti").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("machine").orderBy("task_id")) - 1) / size))
    return free.groupBy("machine", "batch").agg(F.count("*").alias("tasks"), F.sum("length").alias("length")).filter("tasks >= 2")


def time_share(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(key)), 6))


def io_rate(samples: DataFrame) -> DataFrame:
    """Change of a counter over the seconds since the node's sample before."""
    placed = in_order(samples, ["node_id"], ["at", "sample_id"], before={"__at_before": F.col("at"), "__memory_before": F.col("memory")})
    dt = (F.unix_micros("at") - F.unix_micros("__at_before")) / 1_000_000
    return placed.select(*samples.columns, F.round((F.col("memory") - F.col("__memory_before")) / dt, 6).alias("rate"))
