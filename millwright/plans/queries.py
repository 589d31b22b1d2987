"""Registered queries of the library, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions import columns as C
from millwright.functions import udtf
from millwright.operators import balance, graph, joins, models, nodes, reports, windows
from millwright.plans import adapters as A
from millwright.plans.views import statement
from millwright.sources import readers, writers
from millwright.sources.shared import moved, new_folder
from millwright.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The end of the period that queries about "now" look back from.
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = statement(sql)
        return f

    return add


_EXEC = "(completed_us - started_us) / 1e6"
_QUEUE = "(scheduled_us - created_us) / 1e6"
_RATE = "round(coalesce(avg(cast(status = 'completed' as double)) * 100, 0.0), 4)"


def _timed(s, d):
    return reports.with_durations(A.tasks(s, d))


# Aggregations


@query(f"select count(*) as total, count_if(status = 'completed') as completed, count_if(status = 'failed') as failed, {_RATE} as success_percent, round(avg({_QUEUE}), 4) as avg_queue, round(avg({_EXEC}), 4) as avg_exec, round(count_if(status = 'completed') / ((max(completed_us) - min(completed_us)) / 3600000000), 4) as per_hour from v_tasks")
def task_summary(s, d):
    return reports.task_summary(A.tasks(s, d))


@query(f"select algorithm, count(*) as tasks, {_RATE} as success_percent from v_tasks group by 1")
def algorithm_performance(s, d):
    return reports.algorithm_performance(A.tasks(s, d))


@query(f"select node_id, count(*) as tasks, {_RATE} as success_percent, round(avg({_EXEC}), 4) as avg_exec from v_tasks where node_id is not null group by 1")
def node_summary(s, d):
    return reports.node_summary(A.tasks(s, d))


@query(f"select strftime(make_timestamp(created_us), '%Y-%m-%d %H:00') as hour, count(*) as tasks, count_if(status = 'completed') as completed, {_RATE} as completed_percent from v_tasks group by 1")
def hourly_distribution(s, d):
    return reports.hourly_distribution(A.tasks(s, d))


@query(f"select strftime(make_timestamp(completed_us), '%Y-%m-%d %H:00') as hour, round(avg({_EXEC}), 4) as value from v_tasks group by 1")
def performance_trend(s, d):
    return reports.performance_trend(A.tasks(s, d), "exec_time")


@query("select algorithm, node_id, count(*) as decisions from v_decisions group by grouping sets ((algorithm), (node_id))")
def decision_usage(s, d):
    return reports.decision_usage(A.decisions(s, d))


@query(f"""with r as (select build_id, {_EXEC} as x, row_number() over (partition by build_id order by {_EXEC}) as p, count(*) over (partition by build_id) as n from v_tasks)
    select build_id, count(*) as n, round(avg(x), 4) as mean, round(median(x), 4) as median, round(max(case when p = round_even(0.9 * (n - 1), 0) + 1 then x end), 4) as p90,
    round(max(case when p = round_even(0.95 * (n - 1), 0) + 1 then x end), 4) as p95, round(max(case when p = round_even(0.99 * (n - 1), 0) + 1 then x end), 4) as p99 from r group by 1""")
def metric_percentiles(s, d):
    return reports.metric_percentiles(_timed(s, d), ["build_id"], "exec_seconds")


@query(f"""with g as (select algorithm, {_EXEC} as x from v_tasks where status = 'completed'), r as (select *, row_number() over (partition by algorithm order by x) as p, count(*) over (partition by algorithm) as n from g),
    q as (select algorithm, avg(x) as mean, max(x) as longest, max(n) as n, max(case when p = floor(19 * (n + 1) / 20) then x end) as a, max(case when p = floor(19 * (n + 1) / 20) + 1 then x end) as b, max(19 * (n + 1) / 20 - floor(19 * (n + 1) / 20)) as f from r group by 1),
    t as (select algorithm, count(*) as total, count_if(status = 'completed') as success, count_if(status <> 'completed') as failed from v_tasks group by 1)
    select t.*, round(mean, 4) as mean, round(case when n >= 20 then a + f * (coalesce(b, a) - a) else longest end, 4) as p95, round(longest, 4) as longest from t left join q using (algorithm)""")
def quantile_summary(s, d):
    return reports.quantile_summary(_timed(s, d), ["algorithm"], "exec_seconds", F.col("status") == "completed")


@query("select status, count(*) as tasks from v_tasks group by 1 union all select 'total', count(*) from v_tasks")
def queue_stats(s, d):
    return reports.queue_stats(A.tasks(s, d))


@query("""with l as (select node_id, arg_max({'cpu': cpu, 'memory': memory, 'load': load}, (at_us, sample_id)) as x from v_node_metrics group by 1), n as (select v_nodes.*, x.cpu as cpu, x.memory as memory, x.load as load from v_nodes left join l using (node_id))
    select count(*) as nodes, count(load) as online, count_if(load < slots) as available, cast(sum(slots) as bigint) as slots, cast(coalesce(sum(load), 0) as bigint) as used, round(coalesce(sum(load), 0) / sum(slots) * 100, 4) as used_percent, round(avg(cpu), 4) as avg_cpu, round(avg(memory), 4) as avg_memory from n""")
def cluster_stats(s, d):
    return reports.cluster_stats(A.nodes(s, d), A.node_metrics(s, d))


@query(f"""select build_id, round((max(completed_us) - min(started_us)) / 1e6, 4) as wall, round(sum({_EXEC}), 2) as exec_sum, round(sum({_EXEC}) / ((max(completed_us) - min(started_us)) / 1e6), 4) as parallelism,
    count_if(status = 'completed') as ok, count_if(status = 'failed') as failed, count_if(status = 'failed') = 0 as success from v_tasks group by 1""")
def build_summary(s, d):
    return reports.build_summary(A.tasks(s, d))


@query(f"""select algorithm, count_if(status = 'completed') as completed, count_if(status = 'failed') as failed, {_RATE} as rate, round(avg({_EXEC}), 4) as avg_exec, round(max({_EXEC}), 4) as max_exec, round(min({_EXEC}), 4) as min_exec,
    round(count(*) / ((max(completed_us) - min(started_us)) / 1e6), 6) as per_second from v_tasks group by 1""")
def benchmark_summary(s, d):
    return reports.benchmark_summary(A.tasks(s, d), "algorithm")


@query("select algorithm, count_if(status = 'completed') as completed, count_if(status = 'failed') as failed, count_if(status = 'cancelled') as cancelled from v_tasks group by 1")
def benchmark_matrix(s, d):
    return reports.benchmark_matrix(A.tasks(s, d), "algorithm", "status", ["completed", "failed", "cancelled"])


@query(f"""with p as (select build_id, node_id, sum({_EXEC}) as busy, min(started_us) as a, max(completed_us) as b from v_tasks group by 1, 2)
    select build_id, count(*) as nodes, round(sum(busy) / count(*), 4) as ideal, round((max(b) - min(a)) / 1e6 - sum(busy) / count(*), 4) as overhead, round(sum(busy) / count(*) / ((max(b) - min(a)) / 1e6) * 100, 4) as used_percent, round(max(busy) / avg(busy), 4) as bottleneck from p group by 1""")
def parallel_metrics(s, d):
    return reports.parallel_metrics(A.tasks(s, d))


@query(f"""with t as (select build_id, (max(completed_us) - min(started_us)) / 3600000000 * count(distinct node_id) * 0.5 as c, sum({_EXEC}) / 3600 * 2.0 as s from v_tasks group by 1)
    select build_id, round(c, 4) as distributed, round(s, 4) as single, round((s - c) / s * 100, 4) as saved_percent from t""")
def cost_analysis(s, d):
    return reports.cost_analysis(A.tasks(s, d))


@query("select kind, count(*) as events from v_server_stats group by 1")
def event_counters(s, d):
    return reports.event_counters(A.server_stats(s, d))


@query("select file, kind, seconds from v_server_stats order by seconds desc, id limit 1")
def longest_job(s, d):
    return reports.longest_job(A.server_stats(s, d))


@query(f"""with q as (select algorithm, coalesce(0.7 * avg(cast(status = 'completed' as double)) + 0.3 / (1 + avg(case when status = 'completed' then {_EXEC} end)), 0.5) as score from v_tasks group by 1)
    select algorithm, round(score, 6) as score, round(score / sum(score) over (), 6) as share from q""")
def algorithm_score(s, d):
    return reports.algorithm_score(A.tasks(s, d))


@query(f"""with t as (select file, {_EXEC} as x from v_tasks), m as (select *, median(x) over (partition by file) as med from t)
    select file, round(max(med), 4) as median, round(median(abs(x - med)), 4) as mad from m group by 1""")
def robust_estimate(s, d):
    return reports.robust_estimate(_timed(s, d), ["file"], "exec_seconds")


@query(f"""with r as (select file, {_EXEC} as x, row_number() over (partition by file order by {_EXEC}) as p, count(*) over (partition by file) as n from v_tasks), c as (select *, case when n < 3 then 0 else floor(n * 0.1) end as k from r)
    select file, round(avg(x), 4) as trimmed_mean from c where p > k and p <= n - k group by 1""")
def trimmed_mean(s, d):
    return reports.trimmed_mean(_timed(s, d), ["file"], "exec_seconds")


@query(f"select file, count(*) as samples, round(stddev_pop({_EXEC}) / avg({_EXEC}), 6) as cv, stddev_pop({_EXEC}) / avg({_EXEC}) > 0.3 as unstable from v_tasks group by 1 having count(*) >= 3 and avg({_EXEC}) > 0")
def time_cv(s, d):
    return reports.time_cv(_timed(s, d), ["file"], "exec_seconds")


@query(f"select node_id, count(*) as tasks, round(sum({_EXEC}), 2) as busy from v_tasks group by 1")
def node_load(s, d):
    return reports.task_busy_seconds(A.tasks(s, d)).groupBy("node_id").agg(F.count("*").alias("tasks"), F.round(F.sum("seconds"), 2).alias("busy"))


@query("with c as (select node_id, count(*) as steps from v_tasks group by 1) select 'c' || (node_id % 10) as container, cast(sum(steps) as bigint) as steps, round(sum(steps) / sum(sum(steps)) over () * 100, 4) as share from c group by 1")
def container_usage(s, d):
    c = A.tasks(s, d).groupBy(F.concat(F.lit("c"), (F.col("node_id") % 10).cast("string")).alias("container")).agg(F.count("*").alias("steps"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("steps").alias("n")))).select("container", "steps", F.round(F.col("steps") / F.col("n") * 100, 4).alias("share"))


@query("""with m as (select build_id, avg(cast(status = 'completed' as double)) * 100 as ok, count(distinct node_id) as n from v_tasks group by 1)
    select build_id, 'low_success' as advice from m where ok < 60 union all select build_id, 'imbalance' from m where n > 100 and n * 1.0 > 60 union all select build_id, 'idle' from m where n / 2.0 < 50""")
def recommendations(s, d):
    m = A.tasks(s, d).groupBy("build_id").agg((F.avg((F.col("status") == "completed").cast("double")) * 100).alias("success_percent"), F.count_distinct("node_id").alias("n"))
    m = m.select("build_id", "success_percent", F.when(F.col("n") > 100, F.col("n").cast("double")).otherwise(0.0).alias("cv"), (F.col("n") / 2).alias("used_percent"))
    return reports.recommendations(m)


@query("select count(*) as files, count(distinct regexp_extract(path, '[^/]*$')) as names, count(distinct regexp_replace(path, '/[^/]*$', '')) as folders from v_sources")
def index_stats(s, d):
    return A.sources(s, d).agg(F.count("*").alias("files"), F.count_distinct(C.basename("path")).alias("names"), F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("folders"))


@query("""with f as (select split_part(path, '/', 3) as source, path, sha256(path || ':' || size) as h from v_sources), r as (select source, substr(sha256(path), 1, 2) as part, sha256(string_agg(h, ',' order by path)) as h, count(*) as n from f group by 1, 2)
    select source, cast(sum(n) as bigint) as files, sha256(string_agg(h, ',' order by part)) as fingerprint from r group by 1""")
def project_fingerprint(s, d):
    p = A.sources(s, d).select(F.split_part("path", F.lit("/"), F.lit(3)).alias("source"), "path", F.concat_ws(":", "path", "size").alias("stamp"))
    return reports.merkle_fingerprint(p, ["source"], "path", "stamp")


@query("""select node_id, count_if(k = 'c') as c, count_if(k = 'cpp') as cpp, count_if(k = 'other') as other from (select node_id, case task_id % 3 when 0 then 'c' when 1 then 'cpp' else 'other' end as k from v_tasks) group by 1""")
def node_file_types(s, d):
    t = A.tasks(s, d).withColumn("path", F.concat("file", F.element_at(F.array(*map(F.lit, (".c", ".cpp", ".txt"))), (F.col("task_id") % 3 + 1).cast("int"))))
    return reports.benchmark_matrix(t.withColumn("kind", C.task_type("path")), "node_id", "kind", ["c", "cpp", "other"])


# Balance and comparison

_CV = "coalesce(stddev_samp(tasks), 0)"


@query(f"select algo, run, cast(sum(tasks) as bigint) as total, count(*) as nodes, round(avg(tasks), 4) as mean, round({_CV}, 4) as std, round({_CV} / avg(tasks) * 100, 4) as cv, min(tasks) as least, max(tasks) as most, max(tasks) - min(tasks) as range from v_run_results group by 1, 2")
def balance_metrics(s, d):
    return balance.balance_metrics(A.run_results(s, d), ["algo", "run"])


@query("""with r as (select *, sum(tasks) over (partition by algo, run order by tasks, node rows unbounded preceding) as c from v_run_results)
    select algo, run, round((count(*) + 1 - 2 * sum(c) / sum(tasks)) / count(*), 6) as gini from r group by 1, 2""")
def gini(s, d):
    return balance.gini(A.run_results(s, d), ["algo", "run"])


@query("select algo, run, node, tasks, cast(sum(tasks) over (partition by algo, run order by tasks, node rows unbounded preceding) as bigint) as running from v_run_results")
def gini_terms(s, d):
    return balance.gini_terms(A.run_results(s, d), ["algo", "run"], "tasks", "node").select("algo", "run", "node", "tasks", "running")


@query("""with p as (select algo, run, sum(elapsed) as e, coalesce(stddev_samp(tasks), 0) / avg(tasks) * 100 as cv from v_run_results group by 1, 2)
    select algo, count(*) as runs, round(avg(e), 2) as mean, round(coalesce(stddev_samp(e), 0), 2) as std, round(min(e), 2) as least, round(max(e), 2) as most, round(avg(cv), 4) as mean_cv from p group by 1""")
def run_summary(s, d):
    return balance.run_summary(A.run_results(s, d))


@query("with t as (select algo, sum(elapsed) as elapsed from v_run_results group by 1) select algo, round(elapsed, 2) as elapsed, round((select elapsed from t where algo = 'N') / elapsed, 6) as speedup from t")
def baseline_speedup(s, d):
    return balance.baseline_speedup(A.run_results(s, d).groupBy("algo").agg(F.sum("elapsed").alias("elapsed")), "algo", "elapsed", "N")


@query("with t as (select algo, round(sum(elapsed), 2) as elapsed from v_run_results group by 1) select algo, elapsed, rank() over (order by elapsed) as rank from t")
def rank_algorithms(s, d):
    return balance.rank_algorithms(A.run_results(s, d).groupBy("algo").agg(F.round(F.sum("elapsed"), 2).alias("elapsed")), "algo", "elapsed")


_PAIRS = "select a.file, a.seconds as a_seconds, b.seconds as b_seconds, round(b.seconds / a.seconds, 6) as speedup from v_file_times a join v_file_times b on a.file = b.file and a.backend = 'F' and b.backend = 'O'"


@query(_PAIRS)
def compare_runs_per_file(s, d):
    return balance.compare_runs_per_file(A.file_times(s, d), "F", "O")


@query(f"select * from ({_PAIRS}) order by speedup desc, file limit 10")
def top_speedups(s, d):
    return compare_runs_per_file(s, d).orderBy(F.col("speedup").desc(), "file").limit(10)


@query(f"select * from ({_PAIRS}) order by speedup, file limit 10")
def top_slowdowns(s, d):
    return compare_runs_per_file(s, d).orderBy("speedup", "file").limit(10)


@query("""with a as (select node, sum(tasks) as a from v_run_results where algo = 'A' and node % 3 <> 0 group by 1), b as (select node, sum(tasks) as b from v_run_results where algo = 'N' and node % 5 <> 0 group by 1)
    select coalesce(a.node, b.node) as node, cast(coalesce(a, 0) as bigint) as a, cast(coalesce(b, 0) as bigint) as b, cast(coalesce(b, 0) - coalesce(a, 0) as bigint) as difference from a full join b on a.node = b.node""")
def compare_distribution(s, d):
    r = A.run_results(s, d).filter("(algo = 'A' and node % 3 <> 0) or (algo = 'N' and node % 5 <> 0)")
    return balance.compare_distribution(r, "algo", "A", "N")


@query("select mode, module, count(*) as failures from v_failures where failed group by grouping sets ((mode, module), (module))")
def failures_by_module(s, d):
    return balance.failures_by_module(A.failures(s, d))


@query("select file, count(*) as failures, count_if(mode = 'F') as mode_F, count_if(mode = 'O') as mode_O from v_failures where failed group by 1")
def failures_by_file(s, d):
    return balance.failures_by_file(A.failures(s, d), ["F", "O"])


@query("select module, count(*) as failures from v_failures where failed group by 1 order by failures desc, module limit 20")
def top_failures(s, d):
    return A.failures(s, d).filter("failed").groupBy("module").agg(F.count("*").alias("failures")).orderBy(F.col("failures").desc(), "module").limit(20)


@query("with p as (select mode, file, count(*) as failures from v_failures where failed group by 1, 2) select file, cast(sum(failures) as bigint) as failures from p group by 1")
def combine_modes(s, d):
    f = A.failures(s, d).filter("failed")
    return nodes.combine_modes([f.filter(F.col("mode") == m).groupBy("file").agg(F.count("*").alias("failures")) for m in ("F", "O")])


@query("""with p as (select machine, sum("end" - start) as busy from v_schedule group by 1), n as (select count(*) as n, max("end") - min(start) as makespan, max("end") as finish from v_schedule),
    e as (select "end" as t, row_number() over (order by "end") as p from v_schedule), x as (select count(*) as c from v_edges e join v_schedule a on a.task_id = e.src join v_schedule b on b.task_id = e.dst where a.machine <> b.machine)
    select cast(makespan as bigint) as makespan, cast((select t from e where p = floor(n.n * 0.95) + 1) as bigint) as p95, cast(finish - (select t from e where p = floor(n.n * 0.95) + 1) as bigint) as tail, round((select stddev_pop(busy) from p), 4) as load_std, (select c from x) as cross_edges from n""")
def schedule_metrics(s, d):
    return balance.schedule_metrics(A.schedule(s, d), A.edges(s, d))


@query("select round(avg(cast(a.machine = b.m as double)), 6) as similarity, count(*) as common from v_schedule a join (select task_id, task_id * 3 % 10 as m from v_schedule where task_id % 2 = 0) b using (task_id)")
def assignment_similarity(s, d):
    a = A.schedule(s, d)
    return balance.assignment_similarity(a, a.filter("task_id % 2 = 0").withColumn("machine", F.col("task_id") * 3 % 10), "task_id", "machine")


# Windows


@query("select task_id, file, cast(r as bigint) as recency from (select *, row_number() over (partition by file order by completed_us desc, task_id desc) as r from v_tasks) where r <= 10")
def recent_samples(s, d):
    return windows.recent_samples(A.tasks(s, d), ["file"], [F.col("completed_at").desc(), F.col("task_id").desc()]).select("task_id", "file", F.col("recency").cast("long").alias("recency"))


@query(f"select task_id, round(avg(case when {_EXEC} > 0 then least(2.0, greatest(0.5, 60.0 / ({_EXEC}))) else 1.0 end) over (partition by node_id order by completed_us, task_id rows between 19 preceding and current row), 6) as speedup from v_tasks")
def rolling_speedup(s, d):
    return windows.rolling_speedup(_timed(s, d), "node_id", ["completed_at", "task_id"], F.lit(60.0), F.col("exec_seconds")).select("task_id", "speedup")


_EMA = f"""with r as (select node_id, {_EXEC} as x, row_number() over (partition by node_id order by completed_us, task_id) as i, count(*) over (partition by node_id) as n from v_tasks where status = 'completed')
    select node_id, round(sum(case when i = 1 then pow(0.9, n - 1) else 0.1 * pow(0.9, n - i) end * x), 4) as ema, cast(max(n) as bigint) as n from r group by 1"""


@query(_EMA)
def ema_compile_time(s, d):
    return windows.ema_compile_time(_timed(s, d))


@query(_EMA)
def ema_compile_time_by_day(s, d):
    return windows.ema_by_day(_timed(s, d).filter("status = 'completed'"), "node_id", "build_id", ["completed_at", "task_id"], "exec_seconds", 0.1)


@query("select task_id, round(avg(cast(status = 'completed' as double)) over (partition by node_id order by completed_us, task_id rows unbounded preceding), 6) as rate from v_tasks")
def running_success_rate(s, d):
    return windows.running_success_rate(A.tasks(s, d)).select("task_id", "rate")


@query("""with r as (select *, row_number() over (partition by node_id order by at_us desc, sample_id desc) as q from v_node_metrics), t as (select *, count(*) over (partition by node_id) - q as x, count(*) over (partition by node_id) as n from r where q <= 10),
    l as (select node_id, max(n) as n, regr_slope(load, x) as m, regr_intercept(load, x) as b, arg_max(load, x) as now from t group by 1)
    select node_id, round(greatest(0.0, least(slots, case when n < 2 then now else b + m * (n - 1 + 5.0) end)) / slots, 6) as forecast from l join v_nodes using (node_id)""")
def forecast_load(s, d):
    return windows.forecast_load(A.node_metrics(s, d), A.nodes(s, d))


@query("with r as (select node_id, load, row_number() over (partition by node_id order by at_us, sample_id) as x from v_node_metrics) select node_id, round(regr_slope(load, x), 6) as slope from r group by 1")
def trend_slope(s, d):
    return windows.trend_slope(A.node_metrics(s, d), "node_id", ["at", "sample_id"], "load")


@query("""with g as (select machine, greatest(lead(start) over (partition by machine order by start, task_id) - "end", 0) as gap from v_schedule) select machine, cast(sum(gap) as bigint) as idle, count(*) as intervals from g group by 1""")
def idle_gaps(s, d):
    return windows.idle_gaps(A.schedule(s, d))


@query("select task_id, build_id, row_number() over (partition by build_id order by started_us, task_id) as step from v_tasks")
def step_numbers(s, d):
    return windows.step_numbers(A.tasks(s, d)).select("task_id", "build_id", F.col("step").cast("long").alias("step"))


@query("select task_id, status, before from (select *, lag(status) over (partition by node_id order by completed_us, task_id) as before from v_tasks) where status is distinct from before")
def status_changes(s, d):
    return windows.status_changes(A.tasks(s, d)).select("task_id", "status", "before")


@query("select conv_id, turn, role, lead(turn * 5) over (partition by conv_id order by turn, role, text) - turn * 5 as lasted, turn % 8 as phase from conversations")
def phase_durations(s, d):
    c = A.table(s, d, "conversations").withColumn("at", F.col("turn") * 5).withColumn("phase", F.col("turn") % 8)
    return windows.phase_durations(c, ["conv_id"], "at", ["turn", "role", "text"]).select("conv_id", "turn", "role", "lasted", "phase")


_HIT = "cast(kind in ('COMPILE_OK', 'COMPILE_ERROR', 'COMPILE_TIMEOUT', 'COMPILE_DISCONN') as int)"


@query("select id, node_id, " + ", ".join(f"cast(sum({_HIT}) over (partition by node_id order by stopped_us // 1000000 range between {n - 1} preceding and current row) as bigint) as last_{n}" for n in (60, 300, 900)) + " from v_server_stats")
def running_compile_totals(s, d):
    return windows.running_compile_totals(A.server_stats(s, d))


@query("""with m as (select node_id, started_us // 60000000 as minute, count(*) as load from v_server_stats group by 1, 2)
    select node_id, minute, load, round(avg(load) over (partition by node_id order by minute rows between 4 preceding and current row), 6) as mean_5, round(avg(load) over (partition by node_id order by minute rows between 14 preceding and current row), 6) as mean_15 from m""")
def minute_load_averages(s, d):
    return windows.minute_load_averages(A.server_stats(s, d))


@query("select task_id, attempt from (select *, row_number() over (partition by node_id order by decided_us desc, task_id desc, attempt desc) as r, count(*) over (partition by node_id) as n from v_decisions) where r <= 60 and n >= 20")
def adaptive_window(s, d):
    return windows.adaptive_window(A.decisions(s, d)).select("task_id", "attempt")


@query("""with o as (select *, "end" - start as len, avg("end" - start) over (partition by machine) as mean from v_schedule), tied as (select distinct unnest([e.src, e.dst]) as task_id from v_edges e join v_schedule a on a.task_id = e.src join v_schedule b on b.task_id = e.dst where a.machine = b.machine),
    f as (select *, (row_number() over (partition by machine order by task_id) - 1) // 5 as batch from o where len < 0.3 * mean and task_id not in (select task_id from tied))
    select machine, batch, count(*) as tasks, cast(sum(len) as bigint) as length from f group by 1, 2 having count(*) >= 2""")
def small_task_batches(s, d):
    return windows.small_task_batches(A.schedule(s, d), A.edges(s, d))


@query("select algo, run, node, round(tasks / sum(tasks) over (partition by algo, run), 6) as share from v_run_results")
def time_share(s, d):
    r = A.run_results(s, d).withColumn("g", F.concat("algo", "run"))
    return windows.time_share(r, "g", "tasks").select("algo", "run", "node", "share")


@query("select sample_id, round((memory - lag(memory) over w) / ((at_us - lag(at_us) over w) / 1e6), 6) as rate from v_node_metrics window w as (partition by node_id order by at_us, sample_id)")
def io_rate(s, d):
    return windows.io_rate(A.node_metrics(s, d)).select("sample_id", "rate")


@query("select sample_id from (select *, row_number() over (partition by node_id order by at_us desc, sample_id desc) as r from v_node_metrics) where r <= 100")
def bounded_history(s, d):
    return windows.recent_samples(A.node_metrics(s, d), ["node_id"], [F.col("at").desc(), F.col("sample_id").desc()], 100).select("sample_id")


# Joins


@query("select t.task_id, confidence, attempt from v_tasks t left join v_decisions using (task_id)")
def tasks_with_decisions(s, d):
    return joins.tasks_with_decisions(A.tasks(s, d), A.decisions(s, d)).select("task_id", "confidence", "attempt")


@query("select task_id, confidence, attempt from (select *, row_number() over (partition by task_id order by attempt desc) as r from v_decisions) where r = 1")
def latest_decision(s, d):
    return joins.latest_decision(A.decisions(s, d)).select("task_id", "confidence", "attempt")


_RESOLVED = r"""i as (select file_id, regexp_replace(path, '/[^/]*$', '') as folder, search, unnest(regexp_extract_all(text, '#include\s*["<]([^">\n]+)[">]', 1)) as name, generate_subscripts(regexp_extract_all(text, '#include\s*["<]([^">\n]+)[">]', 1), 1) - 1 as n from v_includers),
    h as (select distinct path, regexp_extract(path, '[^/]*$') as base from v_headers),
    deep as (select i.file_id, i.n, path as target, list_position(list_prepend(folder, search), regexp_replace(left(path, length(path) - length(name)), '/$', '')) as place from i join h on contains(name, '/') and base = regexp_extract(name, '[^/]*$') and list_contains(list_transform(list_prepend(folder, search), lambda f: f || '/' || name), path)),
    bare as (select i.file_id, i.n, path as target, coalesce(list_position(list_transform(list_prepend(folder, search), lambda f: starts_with(path, f || '/')), true), 1000) as place from i join h on not contains(name, '/') and base = name),
    x as (select file_id, n, target, row_number() over (partition by file_id, n order by place, target) as r from (select * from deep union all select * from bare)),
    res as (select i.file_id, i.n, i.name, target from i left join x on x.file_id = i.file_id and x.n = i.n and r = 1)"""


def _resolved(s, d):
    return joins.resolve_includes(A.includers(s, d), A.headers(s, d))


@query(f"with {_RESOLVED} select file_id, n, name, target from res")
def resolve_includes(s, d):
    return _resolved(s, d).withColumn("n", F.col("n").cast("long"))


@query(f"with {_RESOLVED} select distinct p.file_id as src, res.file_id as dst from res join v_headers p on p.path = target where p.file_id <> res.file_id")
def dependency_edges(s, d):
    return joins.dependency_edges(_resolved(s, d), A.headers(s, d))


@query(f"with {_RESOLVED} select file_id, count(*) as unresolved from res where target is null group by 1")
def unresolved_dependencies(s, d):
    return joins.unresolved_dependencies(_resolved(s, d))


@query(f"with {_RESOLVED} select file_id, n, target from res where target like '/root/%' and not target like '/root/common/%'")
def project_dependencies(s, d):
    return joins.project_dependencies(_resolved(s, d), ["/root/common/"], "/root/").select("file_id", F.col("n").cast("long").alias("n"), "target")


@query("""with e as (select id, node_id, file, kind, stopped_us / 1e6 as sec from v_server_stats), w as (select *, last_value(case when kind = 'TCP_ACCEPT' then sec end ignore nulls) over (partition by node_id order by sec, id rows unbounded preceding) as since from e)
    select id, round(sec - since, 3) as wait from w where kind = 'REJ_OVERLOAD' and since is not null""")
def queue_waits(s, d):
    e = A.server_stats(s, d).select("id", "node_id", F.when(F.col("kind") == "TCP_ACCEPT", "scheduled").when(F.col("kind") == "REJ_OVERLOAD", "started").alias("kind"), (F.unix_micros("stopped_at") / 1_000_000).alias("sec"))
    return joins.queue_waits(e, ["node_id"], ["sec", "id"]).select("id", "wait")


@query("""with known as (select path, size, (file_id % 50) + 1.0 as seconds from v_sources where file_id % 3 = 0), o as (select path, avg(seconds) as own from known group by 1),
    b as (select w.size, avg(k.seconds) as m from (select distinct size from v_sources) w join known k on abs(k.size - w.size) < 0.3 * w.size group by 1)
    select file_id, round(coalesce(own, m, s.size * 1e-5), 6) as estimate from v_sources s left join o using (path) left join b on b.size = s.size""")
def size_band_estimate(s, d):
    src = A.sources(s, d).drop("text")
    known = src.filter("file_id % 3 = 0").withColumn("seconds", F.col("file_id") % 50 + 1.0)
    return joins.size_band_estimate(src, known).select("file_id", "estimate")


@query("""with m as (select machine, start as t, 1 as d from v_schedule union all select machine, "end", -1 from v_schedule), n as (select machine, t, sum(d) as d from m group by 1, 2), r as (select machine, sum(d) over (partition by machine order by t rows unbounded preceding) as running from n)
    select machine, cast(max(running) as bigint) as peak from r group by 1""")
def concurrency_peak(s, d):
    return joins.concurrency_peak(A.schedule(s, d), ["machine"], "start", "end")


@query("""select machine, cast(k * 50 as bigint) as at, count(*) as running from v_schedule, generate_series(0, 40) g(k) where start <= k * 50 and k * 50 < "end" group by 1, 2""")
def concurrency_at(s, d):
    return joins.concurrency_at(A.schedule(s, d), ["machine"], F.col("start"), F.col("end"), 50)


@query("""with t as (select id, weight as time, id % 4 = 2 as cuda from v_vertices), n as (select node_id, weight from v_nodes), m as (select id, node_id, round(time / weight * case when cuda and node_id <> 0 then 1000 else 1 end, 6) as cost from t, n)
    select id, node_id, cost from m""")
def exec_cost_matrix(s, d):
    t = A.vertices(s, d).select("id", F.col("weight").alias("time"), (F.col("id") % 4 == 2).alias("cuda"))
    return joins.exec_cost_matrix(t, A.nodes(s, d), F.col("time"), F.col("cuda")).select("id", "node_id", "cost")


@query("select id, node_id, cost from (select *, row_number() over (partition by id order by cost, node_id) as r from (select v.id, n.node_id, round(v.weight / n.weight, 6) as cost from v_vertices v, v_nodes n)) where r = 1")
def cheapest_node(s, d):
    t = A.vertices(s, d).select("id", F.col("weight").alias("time"))
    return joins.cheapest_node(joins.exec_cost_matrix(t, joins.cost_classes(A.nodes(s, d)), F.col("time"), F.lit(False)), "id")


_DEGREES = "i as (select dst as id, count(*) as n from v_edges group by 1), o as (select src as id, count(*) as n from v_edges group by 1), g as (select graph_id, v.id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree from v_vertices v left join i on i.id = v.id left join o on o.id = v.id)"


def _two(s, d):
    e = A.edges(s, d).select("src", "dst")
    return e.filter("src % 2 = 0"), e.filter("dst % 3 = 0")


@query("""with r as (select v.id, min(v.weight / n.weight + n.latency_ms / 1000) as best from v_vertices v, v_nodes n where n.node_id <> 0 group by 1)
    select v.id, case when v.id % 4 = 2 or best is null or v.weight <= best + 0.15 then 'local' else 'remote' end as side from v_vertices v left join r on r.id = v.id""")
def local_or_remote(s, d):
    t = A.vertices(s, d).select("id", F.col("weight").alias("est"), (F.col("id") % 4 == 2).alias("cuda"))
    return joins.local_or_remote(t, A.nodes(s, d)).select("id", "side")


@query("select v.id, n.node_id, round(case when n.node_id = 0 then 0.0 else cast(n.latency_ms as double) / 1000 + cast(v.weight as double) / 12800 end, 9) as comm from v_vertices v, v_nodes n")
def comm_cost_matrix(s, d):
    return joins.comm_cost_matrix(A.vertices(s, d).select("id", "weight"), A.nodes(s, d), F.col("weight")).select("id", "node_id", "comm")


@query("select distinct dst, src from v_edges where src not in (select id from v_vertices where id % 11 <> 0)")
def missing_dependencies(s, d):
    return joins.missing_dependencies(A.edges(s, d), A.vertices(s, d).filter("id % 11 <> 0"))


@query("select unit_id, file not like '%.cu' and unit_id % 6 <> 0 as remote_ok from v_units")
def is_remote_ok(s, d):
    return A.units(s, d).select("unit_id", C.is_remote_ok(F.col("file"), F.col("arguments"), F.col("unit_id") % 6 != 0).alias("remote_ok"))


@query("with a as (select src, dst from v_edges where src % 2 = 0), b as (select src, dst from v_edges where dst % 3 = 0) select (select count(*) from (select * from a intersect select * from b)) as overlap, (select greatest(count(*), 1) from (select * from a union select * from b)) as \"union\"")
def edge_overlap(s, d):
    return nodes.edge_overlap(*_two(s, d))


@query(f"with {_DEGREES} select graph_id, round(avg(in_degree), 6) as mean_in, max(in_degree) as max_in, round(avg(out_degree), 6) as mean_out, max(out_degree) as max_out from g group by 1")
def degree_stats(s, d):
    return graph.degree_stats(A.vertices(s, d), A.edges(s, d))


@query("select id, node_type as kind from v_vertices")
def node_type(s, d):
    return A.vertices(s, d).select("id", C.node_type(F.concat("node_type", F.lit(":x"), "id")).alias("kind"))


@query("select file_id, file_id % 7 = 0 as generated from v_sources")
def needs_generated_include(s, d):
    text = F.concat("text", F.when(F.col("file_id") % 7 == 0, F.lit('\n#include "ui/moc_a.cpp"\n')).otherwise(F.lit('\n#include "moc.h"\n')))
    return A.sources(s, d).select("file_id", C.needs_generated_include(text).alias("generated"))


@query("select event_id, event_id % 3 = 0 as missing from events")
def is_header_missing(s, d):
    n = F.col("event_id") % 3
    stderr = F.when(n == 0, F.concat(F.lit("a.cpp:1: fatal error: inc/x"), F.col("event_id").cast("string"), F.lit(".h: No such file or directory"))).when(n == 1, "ld: cannot find -lm: No such file or directory").otherwise("x.h:3: error: expected ';'")
    return A.table(s, d, "events").select("event_id", C.is_header_missing(stderr).alias("missing"))


@query("select replace(path, '.cpp', '.h') as path, path as source from v_sources where file_id % 3 = 0")
def header_to_source(s, d):
    sources = A.sources(s, d)
    return joins.header_to_source(sources.filter("file_id % 3 = 0").select(F.regexp_replace("path", r"\.cpp$", ".h").alias("path")), sources.select("path"))


@query("select user_id as node_id, strftime(ts, '%Y-%m-%d') as day, round(list_reduce(list(value order by ts, event_id), lambda a, x: 0.9 * a + 0.1 * x), 6) as ema from events group by 1, 2")
def ema(s, d):
    e = A.table(s, d, "events").select(F.col("user_id").alias("node_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct(F.struct("ts", "event_id").alias("at"), "value").alias("p"))
    return e.groupBy("node_id", "day").agg(F.round(C.ema(F.collect_list("p"), 0.1), 6).alias("ema"))  # a node's events of one day


@query("select user_id as node_id, strftime(ts, '%Y-%m-%d') as day, list_sort(list(value))[cast(round_even(0.9 * (count(*) - 1), 0) as bigint) + 1] as p90 from events group by 1, 2")
def nearest_rank_pct(s, d):
    e = A.table(s, d, "events").select(F.col("user_id").alias("node_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return e.groupBy("node_id", "day").agg(C.nearest_rank(F.collect_list("value"), 90).alias("p90"))


@query("""with t as (select event_id % 5 as link, event_id as id, epoch_us(ts) as us, (event_id % 1000) * 1024.0 / 1048576 / ((event_id % 7 + 1) / 8.0) as mb, (event_id % 7 + 1) / 8.0 * 1000 as ms from events where event_id % 1000 > 0),
    r as (select *, row_number() over (partition by link order by us, id) as i, count(*) over (partition by link) as n from t), w as (select *, case when i = 1 then pow(0.7, n - 1) else 0.3 * pow(0.7, n - i) end as f from r)
    select link, round(sum(f * mb), 4) as mb_per_s, round(sum(f * ms), 4) as latency_ms from w group by 1""")
def ema_link(s, d):
    e = A.table(s, d, "events")
    seconds = (F.col("event_id") % 7 + 1) / 8.0
    t = e.select((F.col("event_id") % 5).alias("link"), F.to_date("ts").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("id"), ((F.col("event_id") % 1000) * 1024.0).alias("bytes"), seconds.alias("seconds"))
    return windows.ema_link(t)


_CROSS = "v_edges e join v_schedule a on a.task_id = e.src join v_schedule b on b.task_id = e.dst"


@query(f"select src, dst, a.machine as src_machine, b.machine as dst_machine from {_CROSS} where a.machine <> b.machine")
def cross_machine_edges(s, d):
    return joins.cross_machine_edges(A.edges(s, d), A.schedule(s, d)).select("src", "dst", "src_machine", "dst_machine")


@query(f"""select src, dst, abs(a.machine - b.machine) as comm from {_CROSS} where a.machine <> b.machine and abs(a.machine - b.machine) > 0.3 * (b."end" - b.start) order by comm desc, src, dst limit 10""")
def high_comm_edges(s, d):
    return joins.high_comm_edges(A.edges(s, d), A.schedule(s, d)).select("src", "dst", "comm")


@query(f"""select src, dst from {_CROSS} where b.start < a."end\"""")
def dependency_violations(s, d):
    return joins.dependency_violations(A.edges(s, d), A.schedule(s, d)).select("src", "dst")


_CYCLIC = "(select graph_id, src, dst from v_edges union all select graph_id, dst, src from v_edges where dst % 97 = 0)"


def _cyclic(s, d):
    e = A.edges(s, d)
    return e.unionByName(graph.backward(e.filter("dst % 97 = 0")))


@query(f"select distinct a.src, a.dst from {_CYCLIC} a join {_CYCLIC} b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def mutual_dependencies(s, d):
    return joins.mutual_dependencies(_cyclic(s, d))


@query("""select dst, count_if(src % 11 = 0) as missing, count_if(src % 11 <> 0 and src % 3 = 0) as completed, count_if(src % 11 <> 0 and src % 3 <> 0) as pending, count_if(src % 11 = 0) = 0 and count_if(src % 11 <> 0 and src % 3 <> 0) = 0 as ready from v_edges group by 1""")
def dependency_status(s, d):
    v = A.vertices(s, d)
    return joins.dependency_status(A.edges(s, d), v.filter("id % 3 = 0"), v.filter("id % 11 <> 0"))


@query("""with l as (select node_id, arg_max(status, (completed_us, task_id)) as final, max(completed_us) as seen from v_tasks group by 1) select node_id from l where final = 'failed' and epoch_us(timestamp '2024-01-31 00:00:00') - seen < 86400000000""")
def hosts_in_backoff(s, d):
    return joins.hosts_in_backoff(A.tasks(s, d), F.lit(NOW).cast("timestamp"), seconds=86_400).select("node_id")


@query("select task_id, case when n.node_id is null then 'unknown-' || t.node_id else 'c' || (t.node_id % 10) end as container from v_tasks t left join (select node_id from v_nodes where node_id % 4 = 0) n on n.node_id = t.node_id")
def label_containers(s, d):
    c = A.nodes(s, d).filter("node_id % 4 = 0").select("node_id", F.concat(F.lit("c"), (F.col("node_id") % 10).cast("string")).alias("container"))
    return joins.label_containers(A.tasks(s, d), c).select("task_id", "container")


# Nodes, top-k and sets

_PROFILE = f"""l as (select node_id, arg_max(load, (at_us, sample_id)) as load, arg_max(cpu, (at_us, sample_id)) as cpu from v_node_metrics group by 1), p as (select node_id, avg(case when status = 'completed' then {_EXEC} end) as sec, avg(cast(status = 'completed' as double)) as ok from v_tasks group by 1),
    m as (select node_id, slots, case when node_id % 4 = 3 then 0.0 else weight end as weight, latency_ms, coalesce(cpu, 0) as cpu, coalesce(load, 0) as load, coalesce(load, 0) / slots as ratio, coalesce(sec, 0.0) as sec, coalesce(ok, 1.0) as ok from v_nodes left join l using (node_id) left join p using (node_id)),
    n as (select *, case when weight > 0 then weight else 0.3 * greatest(0.0, 1 - cpu / 100) + 0.3 * greatest(0.0, 1 - ratio) + 0.3 * ok + 0.1 * greatest(0.0, 1 - least(latency_ms / 1000, 1.0)) end as perf from m)"""


def _profile(s, d):
    known = A.nodes(s, d).withColumn("weight", F.when(F.col("node_id") % 4 == 3, 0.0).otherwise(F.col("weight")))  # a quarter of the nodes has no weight of its own
    return nodes.node_profile(known, _timed(s, d), A.node_metrics(s, d))


_OVER_MEAN = "least(1.0, case when avg(score) > 0 then max(score) / avg(score) else 1.0 end)"
for _name, _sql, _sure in (
    ("least_loaded", "-ratio", "1 - least(max(ratio) - min(ratio), 0.5)"),
    ("fastest", "case when sec > 0 then 1 / (1 + sec) else perf end", _OVER_MEAN),
    ("weighted", "0.4 * (1 - ratio) + 0.4 * case when sec > 0 then 1 - sec / max(sec) over () else perf end + 0.2 * ok", _OVER_MEAN),
    ("locality", "0.5 * greatest(0.0, 1 - latency_ms / 1000) + 0.3 * (1 - ratio) + 0.2 * perf + case when latency_ms < 100 then 0.2 else 0.0 end", "max(0.8)"),
):
    query(f"with {_PROFILE}, scored as (select *, round({_sql}, 6) as score from n where load < slots), sure as (select cast(round({_sure}, 6) as double) as confidence from scored) select node_id, row_number() over (order by score desc, node_id) as place, cast(score as double) as score, confidence from scored, sure order by score desc, node_id limit 4", name=f"rank_nodes_{_name}")(lambda s, d, k=_name: nodes.rank_nodes(_profile(s, d), k).withColumn("place", F.col("place").cast("long")))


@query(f"with {_PROFILE} select node_id, load, slots from n where load < slots")
def available_nodes(s, d):
    return nodes.available_nodes(_profile(s, d)).select("node_id", "load", "slots")


@query("select id from v_vertices where id % 2 = 0 and node_type = 'compile' intersect select id from v_vertices where id % 3 = 0 and node_type = 'compile'")
def common_nodes(s, d):
    v = A.vertices(s, d).filter("node_type = 'compile'")
    return nodes.common_nodes(v.filter("id % 2 = 0"), v.filter("id % 3 = 0"))


@query("with a as (select src, dst from v_edges where src % 2 = 0), b as (select src, dst from v_edges where dst % 3 = 0), i as (select * from a intersect select * from b), u as (select * from a union select * from b) select (select count(*) from i) as common, (select count(*) from u) as \"all\", round((select count(*) from i) / (select count(*) from u), 6) as jaccard")
def edge_jaccard(s, d):
    e = A.edges(s, d).select("src", "dst")
    return nodes.set_jaccard(e.filter("src % 2 = 0"), e.filter("dst % 3 = 0"))


@query("with a as (select id from v_vertices where id % 2 = 0), b as (select id from v_vertices where id % 3 = 0), i as (select * from a intersect select * from b), u as (select * from a union select * from b) select (select count(*) from i) as common, (select count(*) from u) as \"all\", round((select count(*) from i) / (select count(*) from u), 6) as jaccard")
def node_jaccard(s, d):
    v = A.vertices(s, d).select("id")
    return nodes.set_jaccard(v.filter("id % 2 = 0"), v.filter("id % 3 = 0"))


_DIFF = "with a as (select src, dst from v_edges where src % 2 = 0), b as (select src, dst from v_edges where dst % 3 = 0) select *, 'a' as only_in from (select * from a except all select * from b) union all select *, 'b' from (select * from b except all select * from a)"


@query(_DIFF)
def edge_diff(s, d):
    return nodes.edge_diff(*_two(s, d))


@query(f"select * from ({_DIFF}) order by src, dst, only_in limit 10")
def top_diff_edges(s, d):
    return nodes.top_diff_edges(*_two(s, d))


@query("select src, dst from v_edges where src % 2 = 0 except select src, dst from v_edges where dst % 3 = 0")
def removed_edges(s, d):
    return nodes.removed_edges(*_two(s, d))


@query("select file_id, size >= 4096 as heavy from v_sources")
def heavy_tasks(s, d):
    return nodes.heavy_tasks(A.sources(s, d).select("file_id", "size"), "size", 4096).select("file_id", "heavy")


@query("select round(avg(cast(size >= 4096 as double)) * 100, 4) as heavy_percent, round(sum(case when size >= 4096 then size else 0 end) / sum(size), 6) as heavy_share from v_sources")
def heavy_coverage(s, d):
    return nodes.heavy_coverage(nodes.heavy_tasks(A.sources(s, d).select("size"), "size", 4096), "size")


@query("select backend, file, seconds from (select *, row_number() over (partition by backend order by seconds desc, file) as r from v_file_times) where r <= 10")
def slowest_files(s, d):
    return nodes.top_by(A.file_times(s, d), ["backend"], [F.col("seconds").desc(), "file"], 10).select("backend", "file", "seconds")


@query("select graph_id, id from (select graph_id, id, count(*) over w0 as n, row_number() over (partition by graph_id order by id) as u, row_number() over (partition by graph_id order by id desc) as v from v_vertices window w0 as (partition by graph_id)) where n <= 64 or u <= 5 or v <= 5")
def link_markers(s, d):
    return nodes.link_markers(A.vertices(s, d).select("graph_id", "id"))


@query("select build_id, task_id from (select build_id, task_id, row_number() over (partition by build_id order by completed_us desc, task_id desc) as r from v_tasks) where r = 1")
def latest_run(s, d):
    return nodes.top_by(A.tasks(s, d), ["build_id"], [F.col("completed_at").desc(), F.col("task_id").desc()], 1).select("build_id", "task_id")


# Graphs

_LEVELS = "walk as (select graph_id, id, 0 as level from v_vertices v where not exists (select 1 from v_edges e where e.dst = v.id) union select e.graph_id, e.dst, level + 1 from walk w join v_edges e on e.src = w.id), lev as (select graph_id, id, cast(max(level) as bigint) as level from walk group by 1, 2)"
_RANKS = "climb as (select graph_id, id, weight as r from v_vertices v where not exists (select 1 from v_edges e where e.src = v.id) union select e.graph_id, e.src, c.r + v.weight from climb c join v_edges e on e.dst = c.id join v_vertices v on v.id = e.src), ranks as (select graph_id, id, max(r) as rank from climb group by 1, 2)"


def _levels(s, d):
    return graph.topological_levels(A.vertices(s, d), A.edges(s, d)).withColumn("level", F.col("level").cast("long"))


def _ranks(s, d):
    return graph.upward_rank(A.vertices(s, d), A.edges(s, d))


@query(f"with recursive {_LEVELS} select * from lev")
def topological_levels(s, d):
    return _levels(s, d)


@query(f"with recursive {_LEVELS} select graph_id, level, count(*) as vertices from lev group by 1, 2")
def level_histogram(s, d):
    return graph.level_histogram(_levels(s, d))


@query(f"with recursive {_LEVELS}, h as (select graph_id, level, count(*) as n from lev group by 1, 2) select graph_id, max(n) as widest, max(level) as depth from h group by 1")
def max_parallelism(s, d):
    return graph.max_parallelism(_levels(s, d))


@query(f"with recursive {_RANKS} select * from ranks")
def upward_rank(s, d):
    return _ranks(s, d)


@query(f"with recursive {_RANKS} select graph_id, max(rank) as length from ranks group by 1")
def critical_path_length(s, d):
    return graph.critical_path_length(_ranks(s, d))


@query(f"""with recursive {_RANKS}, nxt as (select e.graph_id, e.src, arg_max(e.dst, (r.rank, -e.dst)) as dst from v_edges e join ranks r on r.id = e.dst group by 1, 2),
    path as (select graph_id, 0 as step, arg_max(id, (rank, -id)) as id from ranks group by 1 union all select p.graph_id, step + 1, dst from path p join nxt on nxt.src = p.id) select graph_id, cast(step as bigint) as step, id from path""")
def critical_path(s, d):
    return graph.critical_path(_ranks(s, d), A.edges(s, d)).withColumn("step", F.col("step").cast("long"))


@query(f"""with recursive {_RANKS}, i as (select dst as id, count(*) as n from v_edges group by 1), o as (select src as id, count(*) as n from v_edges group by 1)
    select r.graph_id, r.id, round(cast(rank + 0.1 * v.weight + 0.05 * coalesce(o.n, 0) as double) * case when rank = max(rank) over (partition by r.graph_id) then 1.2::double else 1.0::double end * case when coalesce(i.n, 0) > 5 then 1.15::double else 1.0::double end, 6) as priority
    from ranks r join v_vertices v on v.id = r.id left join i on i.id = r.id left join o on o.id = r.id""")
def task_priority(s, d):
    return graph.task_priority(_ranks(s, d), A.vertices(s, d), A.edges(s, d))


@query(f"with recursive {_RANKS}, c as (select graph_id, quantile_cont(rank, 0.8) as cut from ranks group by 1) select r.graph_id, id, rank from ranks r join c on c.graph_id = r.graph_id where rank < cut")
def movable_tasks(s, d):
    return graph.movable_tasks(_ranks(s, d))


@query("with recursive reach as (select graph_id, id from v_vertices where id % 50 = 3 union select e.graph_id, e.dst from reach r join v_edges e on e.src = r.id) select * from reach")
def impacted_tasks(s, d):
    return graph.impacted_tasks(A.vertices(s, d).filter("id % 50 = 3"), A.edges(s, d))


@query("with recursive reach as (select graph_id, id, 0 as hop from v_vertices where id % 50 = 3 union select e.graph_id, e.src, hop + 1 from reach r join v_edges e on e.dst = r.id where hop < 10) select graph_id, id, cast(min(hop) as bigint) as hop from reach group by 1, 2")
def dependency_chain(s, d):
    return graph.dependency_chain(A.vertices(s, d).filter("id % 50 = 3"), A.edges(s, d)).withColumn("hop", F.col("hop").cast("long"))


@query("with recursive reach as (select graph_id, id, 0 as hop from v_vertices where id % 50 = 3 union select e.graph_id, e.dst, hop + 1 from reach r join v_edges e on e.src = r.id where hop < 3) select graph_id, id, cast(min(hop) as bigint) as hop from reach group by 1, 2")
def dependent_chain(s, d):
    return graph.dependent_chain(A.vertices(s, d).filter("id % 50 = 3"), A.edges(s, d), hops=3).withColumn("hop", F.col("hop").cast("long"))


@query("with recursive reach as (select graph_id, id from v_vertices where id % 40 = 1 union select e.graph_id, e.dst from reach r join v_edges e on e.src = r.id where e.dst % 4 <> 0) select * from reach")
def propagate_failures(s, d):
    v = A.vertices(s, d)
    return graph.propagate_failures(v.filter("id % 40 = 1"), A.edges(s, d), v.filter("id % 4 <> 0"))


@query("with recursive reach as (select src as unit, dst as id from v_edges union select r.unit, e.dst from reach r join v_edges e on e.src = r.id) select * from reach")
def include_closure(s, d):
    return graph.include_closure(A.vertices(s, d).select(F.col("id").alias("unit")), A.edges(s, d))


@query("select graph_id, id from v_vertices v where id % 3 <> 0 and not exists (select 1 from v_edges e where e.dst = v.id and e.src % 3 <> 0)")
def ready_tasks(s, d):
    v = A.vertices(s, d)
    return graph.ready_tasks(v, A.edges(s, d), v.filter("id % 3 = 0"))


@query(f"with {_DEGREES} select *, in_degree = 0 as root, out_degree = 0 as leaf, in_degree = 0 and out_degree = 0 as orphan from g")
def roots_leaves(s, d):
    return graph.roots_leaves(A.vertices(s, d), A.edges(s, d))


@query(f"with {_DEGREES} select graph_id, count(*) as vertices, cast(sum(in_degree) as bigint) as edges, max(in_degree) as max_in, max(out_degree) as max_out, count_if(in_degree = 0) as roots, count_if(out_degree = 0) as leaves, round(sum(in_degree) / (count(*) * (count(*) - 1)), 8) as density from g group by 1")
def graph_stats(s, d):
    return graph.graph_stats(A.vertices(s, d), A.edges(s, d))


@query("select graph_id, node_type, count(*) as vertices from v_vertices group by 1, 2")
def type_counts(s, d):
    return graph.type_counts(A.vertices(s, d))


@query(f"""with recursive ce as {_CYCLIC}, r as (select src, dst from ce union select r.src, c.dst from r join ce c on c.src = r.dst), loop as (select src as id from r where src = dst)
    select v.graph_id, v.id from v_vertices v where id in (select id from loop) or (exists (select 1 from r where r.dst = v.id and r.src in (select id from loop)) and exists (select 1 from r where r.src = v.id and r.dst in (select id from loop)))""")
def cyclic_nodes(s, d):
    return graph.cyclic_nodes(A.vertices(s, d), _cyclic(s, d))


@query("with recursive b as (select src, dst from v_edges union select dst, src from v_edges), r as (select id, id as seen from v_vertices union select r.id, b.dst from r join b on b.src = r.seen) select v.graph_id, v.id, min(seen) as cluster from v_vertices v join r on r.id = v.id group by 1, 2")
def dependency_clusters(s, d):
    return graph.dependency_clusters(A.vertices(s, d), A.edges(s, d))


@query("select graph_id, src, dst from v_edges e where not exists (select 1 from v_edges a join v_edges b on a.dst = b.src where a.src = e.src and b.dst = e.dst)")
def transitive_reduction(s, d):
    return graph.transitive_reduction(A.edges(s, d))


@query("select e.graph_id, dst as id, count(*) as producers, string_agg(cast(e.src as varchar), ',' order by e.src) as dependencies from v_edges e join v_vertices a on a.id = e.src join v_vertices b on b.id = e.dst where a.node_type = 'compile' and b.node_type = 'link' group by 1, 2 having count(*) >= 2")
def link_barriers(s, d):
    found = graph.link_barriers(A.vertices(s, d), A.edges(s, d), least=2)  # no vertex of these graphs has more producers
    return found.select("graph_id", "id", "producers", F.array_join(F.transform("dependencies", lambda x: x.cast("string")), ",").alias("dependencies"))


@query("""with p as (select graph_id, id, id % 3 as phase from v_vertices) select graph_id, cast(id as varchar) as src, 'barrier:' || phase as dst from p
    union all select graph_id, 'barrier:' || (phase - 1), cast(id as varchar) from p where exists (select 1 from p q where q.graph_id = p.graph_id and q.phase = p.phase - 1)""")
def phase_barriers(s, d):
    return graph.phase_barriers(A.vertices(s, d).withColumn("phase", F.col("id") % 3))


@query("""with keep as (select id from v_vertices where id % 3 <> 0), kept as (select id from keep union select v.id from v_vertices v join v_edges e on e.dst = v.id where v.node_type = 'link' and e.src in (select id from keep))
    select graph_id, src, dst from v_edges where src in (select id from kept) and dst in (select id from kept)""")
def prune_graph(s, d):
    v = A.vertices(s, d)
    return graph.prune_graph(A.edges(s, d), v.filter("id % 3 <> 0"), links=v.filter("node_type = 'link'")).select("graph_id", "src", "dst")


@query(f"""with recursive v as (select * from v_vertices where id % 13 <> 0), e as (select * from {_CYCLIC} union all select graph_id, id, id from v_vertices where id % 41 = 0),
    ce as (select distinct src, dst from e where src <> dst and src in (select id from v) and dst in (select id from v)), r as (select src, dst from ce union select r.src, c.dst from r join ce c on c.src = r.dst), loop as (select src as id from r where src = dst)
    select distinct graph_id, id, 'unknown' as issue from (select graph_id, unnest([src, dst]) as id from e) where id not in (select id from v) union all select graph_id, src, 'self' from e where src = dst
    union all select graph_id, id, 'orphan' from v where not exists (select 1 from e where e.src = v.id or e.dst = v.id)
    union all select graph_id, id, 'cycle' from v where id in (select id from loop) or (exists (select 1 from r where r.dst = v.id and r.src in (select id from loop)) and exists (select 1 from r where r.src = v.id and r.dst in (select id from loop)))""")
def validate_graph(s, d):
    v = A.vertices(s, d)
    loops = v.filter("id % 41 = 0").select("graph_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    return graph.validate_graph(v.filter("id % 13 <> 0"), _cyclic(s, d).unionByName(loops))


@query("with recursive ch as (select graph_id, id from v_vertices where id % 29 = 0 or id % 31 = 0), reach as (select * from ch union select e.graph_id, e.dst from reach r join v_edges e on e.src = r.id) select * from reach")
def incremental_plan(s, d):
    new = A.vertices(s, d).select("graph_id", "id", F.col("weight").alias("stamp"))
    old = new.filter("id % 31 <> 0").withColumn("stamp", F.when(F.col("id") % 29 == 0, -1).otherwise(F.col("stamp")))
    return graph.incremental_plan(old, new, A.edges(s, d))


# Columns


@query("select unit_id, case when file like '%.cu' then 'cuda' when file like '%.cpp' or file like '%.cc' then 'cpp' when file like '%.c' then 'c' else 'other' end as kind, file like '%.cu' as cuda from v_units")
def task_type(s, d):
    return A.units(s, d).select("unit_id", C.task_type("file").alias("kind"), C.is_cuda("file", "arguments").alias("cuda"))


@query("select unit_id, directory || '/' || 'out/f' || unit_id || '.o' as output from v_units")
def infer_output_path(s, d):
    return A.units(s, d).select("unit_id", C.infer_output(F.lit(None).cast("string"), F.col("arguments"), F.col("file"), F.col("directory")).alias("output"))


@query("select unit_id, 'inc/a' || (unit_id % 5) || ',inc/b' || (unit_id % 3) as paths from v_units")
def include_paths(s, d):
    return A.units(s, d).select("unit_id", F.array_join(C.include_paths(F.col("arguments")), ",").alias("paths"))


@query("select unit_id, substr(md5(arguments[5] || '|' || '-I:inc/a' || (unit_id % 5) || '|' || arguments[4]), 1, 16) as signature from v_units")
def flag_signature(s, d):
    return A.units(s, d).select("unit_id", C.flag_signature(F.col("arguments")).alias("signature"))


@query("select unit_id, '-I,' || arguments[4] || ',' || arguments[5] || ',' || arguments[6] as flags from v_units")
def sanitize_flags(s, d):
    return A.units(s, d).select("unit_id", F.array_join(C.sanitize_flags(F.col("arguments")), ",").alias("flags"))


@query("select unit_id from v_units where contains(file, 'm1/') or regexp_matches(file, 'f1.*\\.cu$')")
def filter_compile_db(s, d):
    return A.units(s, d).filter(F.col("file").contains("m1/") | F.col("file").rlike(r"f1.*\.cu$")).select("unit_id")


@query("select unit_id from v_units where regexp_matches(file, '\\.(c|cc|cxx|cpp)$') and list_contains(arguments, '-c')")
def filter_compile_only(s, d):
    return A.units(s, d).filter(F.col("file").rlike(r"\.(c|cc|cxx|cpp)$") & F.array_contains("arguments", "-c")).select("unit_id")


_SRC = r"""select file_id, size / 1024 as kb, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' and not starts_with(trim(x, ' '), '//'))) as code, len(regexp_extract_all(text, '(?m)^\s*#\s*include\s*[<"][^>"]+[>"]')) as inc, len(regexp_extract_all(text, 'template\s*<')) + len(regexp_extract_all(text, 'std::\w+<')) / 5 as tpl from v_sources"""


@query(f"select file_id, cast(kb * 1024 as bigint) as size_bytes, cast(code as bigint) as code_lines, cast(inc as bigint) as includes, round(tpl, 4) as templates, floor((kb * 0.4::double + code / 10 * 0.3::double + inc * 5.0::double * 0.2::double + tpl * 10.0::double * 0.1::double) * 1000) / 1000 as complexity from ({_SRC})")
def source_complexity(s, d):
    f = C.source_features(F.col("text"))
    return A.sources(s, d).select("file_id", (f["size_kb"] * 1024).cast("long").alias("size_bytes"), f["code_lines"].cast("long").alias("code_lines"), f["includes"].cast("long").alias("includes"), F.round(f["templates"].cast("double"), 4).alias("templates"), (F.floor(f["complexity"] * 1000) / 1000).alias("complexity"))


@query(f"select file_id, round(case when kb < 10 then 0.5::double + kb * 0.15::double when kb < 50 then 2.0::double + (kb - 10) * 0.2::double when kb < 200 then 10.0::double + (kb - 50) * 0.27::double else 50.0::double + (kb - 200) * 0.5::double end + least(floor(tpl) * 2.0::double, 30.0::double) * 0.3::double + least(inc * 0.5::double, 15.0::double) * 0.2::double, 2) as seconds from ({_SRC})")
def estimate_compile_time(s, d):
    f = C.source_features(F.col("text"))
    return A.sources(s, d).select("file_id", C.estimate_compile_time(f["size_kb"], f["includes"], f["templates"]).alias("seconds"))


@query("select file_id, case when size < 65536 then md5(text) else md5(array_slice(encode(text), 1, 4096) || array_slice(encode(text), size // 2 + 1, size // 2 + 4096) || array_slice(encode(text), size - 4095, size)) end as hash from v_sources")
def content_hash(s, d):
    return A.sources(s, d).select("file_id", C.content_hash(F.col("text")).alias("hash"))


@query("select file_id, 'compile:' || substr(path, 12) as task_id from v_sources where path like '/root/src1/%'")
def task_id_of(s, d):
    return A.sources(s, d).select("file_id", C.task_id_of(F.col("path"), "/root/src1").alias("task_id")).filter("task_id is not null")


@query("select file_id, regexp_extract(path, '[^/]*$') as label, case when path like '/root/src1/%' then split_part(path, '/', 4) else 'other' end as module from v_sources")
def node_label(s, d):
    return A.sources(s, d).select("file_id", C.basename("path").alias("label"), C.infer_module(F.col("path"), "/root/src1/").alias("module"))


@query("""select line_no, case when line like '%completed in%' then 'completed' when line like '%scheduled to%' then 'scheduled' when line like '%started on%' then 'started' when line like '%failed:%' then 'failed' else 'heartbeat' end as kind,
    nullif(regexp_extract(line, 'Task (\\S+) ', 1), '') as task, nullif(regexp_extract(line, '(node\\d+)', 1), '') as node, try_cast(nullif(regexp_extract(line, 'completed in ([\\d.]+)s', 1), '') as double) as seconds from v_log""")
def parse_log_event(s, d):
    return A.log_lines(s, d).select("line_no", *[c.alias(n) for n, c in C.log_event(F.col("line")).items()])


@query("""select event_id as line_no, case event_type when 'click' then 'completed' when 'view' then 'assigned' when 'signup' then 'scheduled' when 'purchase' then 'started' when 'error' then 'failed' end as kind,
    case when event_type in ('signup', 'purchase', 'error') then cast(event_id as varchar) end as task, case when event_type in ('view', 'purchase') then '10.0.0.' || (user_id % 250) end as node,
    case when event_type = 'click' then event_id % 900 / 100 end as seconds, case when event_type = 'error' and event_id % 3 <> 0 then 'exit ' || (event_id % 4) end as reason from events""")
def parse_session_log(s, d):
    e = C.session_event(F.col("line"))
    return A.session_lines(s, d).select("line_no", *[c.alias(n) for n, c in e.items()])


@query("""select event_id as line_no, case event_type when 'click' then 'completed' when 'view' then 'assigned' when 'signup' then 'scheduled' when 'purchase' then 'started' when 'error' then 'failed' end as kind,
    case when event_type in ('signup', 'purchase', 'error') then cast(event_id as varchar) end as task, case when event_type in ('view', 'purchase') then '10.0.0.' || (user_id % 250) end as node,
    case when event_type = 'click' then event_id % 900 / 100 end as seconds, case when event_type = 'error' and event_id % 3 <> 0 then 'exit ' || (event_id % 4) end as reason from events where event_type in ('click', 'view', 'signup', 'purchase', 'error')""")
def parse_log_udtf(s, d):
    return udtf.parse_log(A.session_lines(s, d)).drop("line")


@query("select nullif(regexp_extract(line, '(node\\d+)', 1), '') as node, count(*) as tasks from v_log where line like '%completed in%' group by 1")
def node_distribution(s, d):
    e = C.log_event(F.col("line"))
    return A.log_lines(s, d).select(e["kind"].alias("kind"), e["node"].alias("node")).filter("kind = 'completed'").groupBy("node").agg(F.count("*").alias("tasks"))


@query("select regexp_extract(line, 'failed: (.*)$', 1) as reason, count(*) as failures from v_log where line like '%failed:%' group by 1")
def failure_reasons(s, d):
    return A.log_lines(s, d).filter(F.col("line").contains("failed:")).groupBy(F.regexp_extract("line", "failed: (.*)$", 1).alias("reason")).agg(F.count("*").alias("failures"))


@query("select task_id, cast(json_extract_string(factors, '$.k') as bigint) as k from v_decisions where attempt = 1")
def json_fields(s, d):
    return A.decisions(s, d).filter("attempt = 1").select("task_id", F.get_json_object("factors", "$.k").cast("long").alias("k"))


@query("select sample_id, case when cpu / 100 < 0.5 and memory / 100 < 0.6 then 'high' when cpu / 100 < 0.7 and memory / 100 < 0.8 then 'medium' else 'low' end as capacity from v_node_metrics")
def classify_machine(s, d):
    return A.node_metrics(s, d).select("sample_id", C.classify_machine(F.col("cpu"), F.col("memory")).alias("capacity"))


@query(f"select algo, run, case when {_CV} / avg(tasks) * 100 < 10 then 'excellent' when {_CV} / avg(tasks) * 100 < 20 then 'good' else 'fair' end as grade from v_run_results group by 1, 2")
def balance_grade(s, d):
    return balance_metrics(s, d).select("algo", "run", C.balance_grade(F.col("cv")).alias("grade"))


@query(f"select task_id, round({_QUEUE}, 6) as queue_seconds, round({_EXEC}, 6) as exec_seconds from v_tasks")
def task_durations(s, d):
    return _timed(s, d).select("task_id", F.round("queue_seconds", 6).alias("queue_seconds"), F.round("exec_seconds", 6).alias("exec_seconds"))


@query("select node_id, round(case when weight > 0.6 then weight else 0.3 * (1 - (node_id % 100) / 100) + 0.3 * (1 - 0.5) + 0.3 * 0.9 + 0.1 * (1 - least(latency_ms / 1000, 1.0)) end, 6) as score from v_nodes")
def performance_score(s, d):
    w = F.when(F.col("weight") > 0.6, F.col("weight")).otherwise(0.0)
    return A.nodes(s, d).select("node_id", F.round(C.performance_score(w, F.col("node_id") % 100, F.lit(0.5), F.lit(0.9), F.col("latency_ms")), 6).alias("score"))


@query("select src, dst, round(case when a.machine = b.machine then 0.0 else 1 / 1000 + greatest(0.01, (a.\"end\" - a.start) * 1024 * 1.5 / (1024 * 1024)) / 100.0 end, 8) as cost from v_edges e join v_schedule a on a.task_id = e.src join v_schedule b on b.task_id = e.dst")
def comm_cost(s, d):
    p = A.schedule(s, d)
    a, b = p.select(F.col("task_id").alias("src"), F.col("machine").alias("m1"), ((F.col("end") - F.col("start")) * 1024).alias("size")), p.select(F.col("task_id").alias("dst"), F.col("machine").alias("m2"))
    cost = C.comm_cost(F.col("m1"), F.col("m2"), F.lit(None).cast("long"), C.transfer_size_mb(F.col("size")), F.lit(None).cast("double"))
    return A.edges(s, d).join(a, "src").join(b, "dst").select("src", "dst", F.round(cost, 8).alias("cost"))


@query("""with n as (select file_id, size, md5(text) as hash, file_id * 10 as mtime from v_sources where file_id % 23 <> 0),
    o as (select file_id, size + case when file_id % 17 = 0 then 1 else 0 end as size, case when file_id % 20 = 0 then '' else md5(text) end as hash, case when file_id % 13 = 0 then null else file_id * 10 end as mtime from v_sources where file_id % 11 <> 0)
    select coalesce(n.file_id, o.file_id) as file_id, case when o.file_id is null then 'new' when n.file_id is null then 'gone' when n.mtime is distinct from o.mtime then 'mtime' when n.size is distinct from o.size then 'size' when n.hash is distinct from o.hash then 'hash' end as reason
    from n full join o on n.file_id = o.file_id""")
def needs_rebuild_flag(s, d):
    f = A.sources(s, d).select("file_id", "size", F.md5("text").alias("hash"), (F.col("file_id") * 10).alias("mtime"))
    old = f.filter("file_id % 11 <> 0").select("file_id", (F.col("size") + F.when(F.col("file_id") % 17 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("file_id") % 20 == 0, "").otherwise(F.col("hash")).alias("hash"), F.when(F.col("file_id") % 13 != 0, F.col("mtime")).alias("mtime"))
    return joins.needs_rebuild(f.filter("file_id % 23 <> 0"), old, ["file_id"])


# Sources, sinks and streams over data derived from the tables


@query("select algo, run, round(elapsed, 2) as elapsed, node, tasks, sum(tasks) over (partition by algo, run) as total from (select l_returnflag as algo, l_linenumber as run, l_suppkey % 10 as node, count(*) as tasks, sum(count(*)) over (partition by l_returnflag, l_linenumber) / 100 as elapsed from lineitem where l_linenumber <> 3 group by 1, 2, 3)")
def read_run_results(s, d):
    """Time and distribution files of each run, as a benchmark leaves them; runs of number 3 have no time file."""
    folder = new_folder(s)
    spread = A.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("algo"), F.col("l_linenumber").alias("run"), (F.col("l_suppkey") % 10).alias("node")).agg(F.count("*").alias("tasks"))
    runs = spread.groupBy("algo", "run").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), "tasks"))).alias("distribution"), F.sum("tasks").alias("total"))
    writers.write_run_results(runs.withColumn("elapsed", F.round(F.col("total") / 100, 2)), folder, without_time=F.col("run") == 3)
    read = readers.read_run_results(s, folder).select("algo", F.col("run").cast("long").alias("run"), "elapsed", F.explode("distribution").alias("node", "tasks"), "total")
    return read.withColumn("node", F.col("node").cast("long"))


@query("select cast(user_id as double) as node, cast(count(*) as double) as dcc_rq, cast(count_if(event_type = 'error') as double) as dcc_fail from events group by 1")
def read_stats_page(s, d):
    """A page of counters for each node, polled once; the pages of many nodes in a file."""
    folder = new_folder(s)
    counts = A.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("all"), F.count_if(F.col("event_type") == "error").alias("bad"))
    page = F.concat(F.lit("argv /distccd\n<distccstats>\nnode "), F.col("user_id").cast("string"), F.lit("\ndcc_rq "), F.col("all").cast("string"), F.lit("\ndcc_fail "), F.col("bad").cast("string"), F.lit("\ndcc_cpu n/a\n</distccstats>"))
    counts.select(page.alias("value")).write.option("maxRecordsPerFile", 100_000).text(folder)
    return readers.read_stats_page(s, folder, ["node", "dcc_rq", "dcc_fail"])


@query("select line from v_log")
def read_log_lines(s, d):
    A.log_lines(s, d).select("line").write.text(path := new_folder(s))
    return readers.read_log_lines(s, path).select("line")


@query("select directory, file, list_aggregate(arguments, 'string_agg', ' ') as command from v_units where file not like '%.cu'")
def read_compile_db(s, d):
    one = F.to_json(F.collect_list(F.struct("directory", "arguments", "file"))).alias("value")
    A.units(s, d).groupBy(F.floor(F.col("unit_id") / 1000).alias("part")).agg(one).write.partitionBy("part").text(path := new_folder(s))  # a file of a thousand units
    return readers.read_compile_db(s, path).select("directory", "file", F.array_join("arguments", " ").alias("command"))


_HOSTS = "select 'h' || node_id as host, 3000 + node_id % 100 as port, case when node_id % 5 <> 0 then slots end as slots from v_nodes"


def _hosts(s, d):
    n = A.nodes(s, d)
    spec = F.concat(F.lit("h"), F.col("node_id").cast("string"), F.lit(":"), (3000 + F.col("node_id") % 100).cast("string"), F.when(F.col("node_id") % 5 != 0, F.concat(F.lit("/"), F.col("slots").cast("string"))).otherwise(""), F.lit(",lzo,cpp # a host"))
    n.select(spec).write.text(path := new_folder(s))
    return readers.read_hosts(s, path)


@query(f"select host, cast(port as integer) as port, cast(slots as integer) as slots, 2 as n_options from ({_HOSTS})")
def read_hosts(s, d):
    return _hosts(s, d).select("host", "port", "slots", F.size("options").alias("n_options"))


@query(f"select cast(sum(coalesce(slots, 1)) as bigint) as capacity from ({_HOSTS})")
def cluster_capacity(s, d):
    return readers.cluster_capacity(_hosts(s, d))


@query("select dst || '.o' as target, src || '.h' as dependency from v_edges")
def read_dep_files(s, d):
    deps = A.edges(s, d).groupBy("dst").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("src").cast("string"), F.lit(".h")))), " \\\n  ").alias("x"))
    deps.select(F.concat(F.col("dst").cast("string"), F.lit(".o: /usr/include/stdio.h \\\n  "), F.col("x"))).write.text(path := new_folder(s))
    return readers.read_dep_files(s, path)


@query("select dst || '.o' as target, string_agg(src || '.h', ' ' order by src || '.h') as dependencies from v_edges group by 1")
def read_makefile_rules(s, d):
    name = lambda c, ending: F.concat(F.col(c).cast("string"), F.lit(ending))
    rules = A.edges(s, d).groupBy(name("dst", ".o").alias("t")).agg(F.array_join(F.array_sort(F.collect_list(name("src", ".h"))), " ").alias("x"))
    rules.select(F.concat("t", F.lit(": before.h\nFLAGS := -O2\n"), "t", F.lit(": "), "x")).write.text(path := new_folder(s))  # the second rule counts
    return readers.read_makefile_rules(s, path).select("target", F.array_join("dependencies", " ").alias("dependencies"))


@query("select task_id, file, status = 'completed' as success from v_tasks")
def read_task_order_table(s, d):
    mark = F.when(F.col("status") == "completed", "✓").otherwise("✗")
    cells = [F.col("task_id").cast("string"), F.col("file"), *[F.lit(c) for c in "abcdef"], mark]
    A.tasks(s, d).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n|---|---|"))).write.text(path := new_folder(s))
    return readers.read_task_order_table(s, path).select(F.get("cells", F.lit(0)).cast("long").alias("task_id"), F.get("cells", F.lit(1)).alias("file"), "success")


@query("""with n as (select algorithm, node_id, count(*) as tasks from v_tasks where node_id is not null group by 1, 2)
    select 'algo-' || algorithm as algo, cast(sum(tasks) over (partition by algorithm) as double) as elapsed, cast(node_id as integer) as port, tasks from n""")
def read_bench_summary(s, d):
    counted = A.tasks(s, d).filter("node_id is not null").groupBy("algorithm", "node_id").agg(F.count("*").alias("tasks"))
    ports = F.array_join(F.collect_list(F.concat(F.lit("port "), F.col("node_id").cast("string"), F.lit(": "), F.col("tasks").cast("string"))), "\n")  # nodes are a dimension table
    parts = counted.groupBy("algorithm").agg(F.sum("tasks").alias("all"), ports.alias("ports"))
    parts.select(F.concat(F.lit("=== algo-"), F.col("algorithm").cast("string"), F.lit(" ===\nTime: "), F.col("all").cast("string"), F.lit(".0 s\n"), "ports")).write.text(path := new_folder(s))
    return readers.read_bench_summary(s, path)


@query("select file, regexp_replace(file, '\\.\\w+$', '.o') as object from v_units where file not like '%.cu'")
def makefile_sources(s, d):
    A.units(s, d).select(F.concat(F.lit("all: "), F.col("file"), F.lit(" x.h"))).write.text(path := new_folder(s))
    return readers.makefile_sources(s, path)


@query("select task_id, status from v_tasks where build_id >= '2024-01-11'")
def telemetry_round_trip(s, d):
    writers.write_telemetry(A.tasks(s, d), path := new_folder(s), "completed_at")
    return s.read.parquet(path).filter("event_date >= date'2024-01-11'").select("task_id", "status")


@query(f"""select cast(task_id as varchar) as task_id, cast(node_id as varchar) as node_id, status, created_us, scheduled_us, completed_us, round({_QUEUE}, 4) as queue_time, round({_EXEC}, 4) as execution_time
    from v_tasks where completed_us >= 1704931200000000""")
def load_telemetry(s, d):
    """Recorded tasks as CSV, a folder for each day, read with the fixed columns; days before are not read at all."""
    have = {"task_id": "task_id", "source_file": "file", "node_id": "node_id", "algorithm_used": "algorithm", "status": "status", "created_at": "created_at", "scheduled_at": "scheduled_at", "started_at": "started_at", "completed_at": "completed_at", "queue_time": "queue_seconds", "execution_time": "exec_seconds"}
    fixed = T.StructType.fromDDL(readers.TELEMETRY["task_executions"])
    rows = _timed(s, d).select(*[(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fixed])
    writers.write_telemetry(rows, path := new_folder(s), "completed_at", "csv")
    found = readers.load_telemetry(s, path, "task_executions", "csv").filter("event_date >= date'2024-01-11'")
    return found.select("task_id", "node_id", "status", *[F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("created", "scheduled", "completed")], *[F.round(c, 4).alias(c) for c in ("queue_time", "execution_time")])


@query("select task_id, status from v_tasks order by created_us desc, task_id desc limit 1000")
def export_recent(s, d):
    writers.export_recent(A.tasks(s, d), path := new_folder(s), "created_at", "task_id")
    return s.read.schema("task_id long, status string").json(path)


@query("select t.task_id, confidence, attempt from v_tasks t left join v_decisions x using (task_id) order by created_us desc, t.task_id desc, attempt desc limit 1000")
def export_joined(s, d):
    return writers.joined_export(A.tasks(s, d), A.decisions(s, d)).select("task_id", "confidence", "attempt")


@query("select 'tasks' as \"table\", count_if(make_timestamp(completed_us) < timestamp '2024-01-11') as removed from v_tasks union all select 'decisions', count_if(make_timestamp(decided_us) < timestamp '2024-01-11') from v_decisions")
def apply_retention(s, d):
    return writers.apply_retention({"tasks": (A.tasks(s, d), "completed_at"), "decisions": (A.decisions(s, d), "decided_at")}, F.lit("2024-01-11").cast("timestamp"))[1]


@query("""select '"' || id || '" [label="' || id || '", fillcolor="' || case node_type when 'compile' then 'lightblue' when 'link' then 'orange' else 'lightgreen' end || '"];' as value from v_vertices union all select '"' || src || '" -> "' || dst || '";' from v_edges""")
def export_edges_dot(s, d):
    writers.export_edges_dot(A.vertices(s, d), A.edges(s, d), path := new_folder(s))
    return s.read.text(path)


_KIND = "case event_type when 'click' then 'completed' when 'error' then 'failed' when 'view' then 'scheduled' when 'signup' then 'cancelled' else 'completed' end"
_STREAM = f"st as (select event_id, epoch_us(ts) as us, user_id as node_id, {_KIND} as kind, value from events)"


#: Parts that a stream's input comes in, in the order of time; each is at least a micro-batch.
_PARTS = 4


def _in_order(rows: DataFrame, by: str, folder: str, *, text: bool = False) -> Iterator[None]:
    """Writes ``rows`` once, each with its part of the range of ``by``, and lets the parts into ``folder``/in one after the other."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.lit(0) if low is None else F.coalesce(F.least(F.floor((F.col(by) - low) * _PARTS / max(1, high - low)), F.lit(_PARTS - 1)), F.lit(0))
    out = (rows.withColumn("part", part).drop(by) if text else rows.withColumn("part", part)).write.partitionBy("part")
    (out.text if text else out.parquet)(f"{folder}/parts")
    none = rows.limit(0).drop(by) if text else rows.limit(0)  # so that there is something to read
    (none.write.text if text else none.write.parquet)(f"{folder}/in/none")
    for k in range(_PARTS):
        if moved(rows.sparkSession, f"{folder}/parts/part={k}", f"{folder}/in/{k}"):
            yield


def _start(out: DataFrame, mode: str, folder: str, parts: Iterable[None], keep) -> None:
    """Runs a stream over each part of its input, going on from what it has kept."""
    for _ in parts:
        out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def _run(out: DataFrame, mode: str, folder: str, parts: Iterable[None]) -> DataFrame:
    """Runs a stream until its input is read, and reads the sink back: a folder for each micro-batch, so that a batch that runs again replaces its own rows."""
    keep = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    schema = T.StructType(out.schema.fields).add("batch", "long")
    out.sparkSession.createDataFrame([], out.schema).write.parquet(f"{folder}/out/batch=-1")
    _start(out, mode, folder, parts, keep)
    return out.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def _events(s, d) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "purchase"), "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "scheduled").otherwise("cancelled")
    return A.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("node_id"), kind.alias("kind"), "value")


def _drained(s, d, job, mode: str, events: DataFrame | None = None) -> DataFrame:
    """What a streaming job gives for all events, read as a stream of several micro-batches."""
    folder = new_folder(s)
    rows = (_events(s, d) if events is None else events).withColumn("us", F.unix_micros("ts"))
    parts = _in_order(rows, "us", folder)
    return _run(job(live.read_events(s, f"{folder}/in/*", files_per_batch=None)), mode, folder, parts)


@query(f"with {_STREAM} select node_id, kind, count(*) as events from st group by 1, 2")
def stream_event_counters(s, d):
    return _drained(s, d, live.stream_event_counters, "update").groupBy("node_id", "kind").agg(F.max("events").alias("events"))


@query(f"with {_STREAM} select strftime(make_timestamp(us), '%Y-%m-%d %H:00') as hour, count(*) as tasks, count_if(kind = 'completed') as completed from st group by 1 having max(us) // 3600000000 < (select max(us) - 600000000 from st) // 3600000000")
def stream_hourly(s, d):
    return _drained(s, d, live.stream_hourly, "append").select(C.hour_bucket("hour").alias("hour"), "tasks", "completed")


@query("""with s as (select *, strftime(ts, '%Y-%m-%d %H:%M:%S') || lpad(cast(event_id as varchar), 12, '0') as stamp from events), n as (select event_id from s where event_type = 'signup' order by stamp desc limit 1)
    select count_if(event_type = 'view') as started, count_if(event_type = 'click') as remote_ok, count_if(event_type = 'error') as local_fallback, min(n.event_id % 11) as pending, min(n.event_id % 7) as ready, min(n.event_id % 5) as running, min(n.event_id % 1000) as completed, min(n.event_id % 3) as failed, min(n.event_id % 2000) as total from events, n""")
def progress_counters(s, d):
    """A live log of several files, a line for each event."""
    folder = new_folder(s)
    e, i = A.table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), F.col("event_id")
    stamp = F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"), F.lpad(i.cast("string"), 12, "0"), F.lit(" - "))
    snapshot = F.concat(F.lit("Status update: {"), F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), (i % m).cast("string")) for k, m in zip(live.QUEUE, (11, 7, 5, 1000, 3, 2000))]), F.lit("}"))
    body = F.when(F.col("event_type") == "view", F.concat(F.lit("Starting task ccdb_"), i.cast("string"))).when(F.col("event_type") == "click", "Remote compilation successful").when(F.col("event_type") == "error", "Falling back to local").when(F.col("event_type") == "signup", snapshot).otherwise("nothing of note")
    parts = _in_order(e.select("us", F.concat(stamp, body).alias("value")), "us", folder, text=True)
    out = _run(live.stream_progress_counters(live.read_log(s, f"{folder}/in/*", files_per_batch=None)), "update", folder, parts)
    return out.orderBy(F.col("batch").desc()).limit(1).drop("batch")


@query(f"with {_STREAM} select event_id, value from st order by value desc, event_id limit 1")
def stream_longest_job(s, d):
    return _drained(s, d, live.stream_longest_job, "update").drop("batch").orderBy(F.col("value").desc(), "event_id").limit(1)


@query("select event_id from events")
def stream_dedupe(s, d):
    return _drained(s, d, lambda e: live.stream_dedupe(e.union(e)).select("event_id"), "append").drop("batch")


@query("select event_id as task_id, cast(0 as bigint) as micros, event_type in ('click', 'purchase') as success from events where event_type <> 'view'")
def stream_task_lifecycle(s, d):
    return _drained(s, d, lambda e: live.stream_task_lifecycle(e, e.filter("kind <> 'scheduled'")), "append").drop("batch")


@query(f"""with {_STREAM}, r as (select node_id, value as x, row_number() over (partition by node_id order by us, event_id) as i, count(*) over (partition by node_id) as n from st where kind = 'completed'), c as (select node_id, count(*) as events, count_if(kind = 'completed') as completed from st group by 1)
    select c.node_id, round(coalesce((select sum(case when i = 1 then pow(0.9, n - 1) else 0.1 * pow(0.9, n - i) end * x) from r where r.node_id = c.node_id), 0.0), 4) as ema, events, completed from c""")
def stream_ema(s, d):
    out = _drained(s, d, live.stream_ema, "update")
    return out.groupBy("node_id").agg(F.max_by(F.struct("ema", "events", "completed"), "events").alias("x")).select("node_id", F.round("x.ema", 4).alias("ema"), "x.events", "x.completed")


_NEEDS = "(select dst as task_id, src as needs from v_edges union all select event_id, -event_id from events where event_id % 100 = 0 union all select id, -id from v_vertices where id % 10 = 0)"


def _needs(s, d) -> DataFrame:
    """What tasks need: producers in the graphs, and for some a task that there is not."""
    odd = lambda rows, k, m: rows.filter(F.col(k) % m == 0).select(F.col(k).alias("task_id"), (-F.col(k)).alias("needs"))
    return A.edges(s, d).select(F.col("dst").alias("task_id"), F.col("src").alias("needs")).unionByName(odd(A.table(s, d, "events"), "event_id", 100)).unionByName(odd(A.vertices(s, d), "id", 10))


@query(f"""with lacking as (select task_id, string_agg(distinct cast(needs as varchar), ',' order by cast(needs as varchar)) as missing from {_NEEDS} where needs not in (select task_id from v_tasks) group by 1)
    select task_id, round((epoch_us(timestamp '2024-01-31 00:00:00') - created_us) / 1e6, 3) as age, coalesce(missing, '') as missing from v_tasks left join lacking using (task_id) where scheduled_us is null and (epoch_us(timestamp '2024-01-31 00:00:00') - created_us) / 1e6 > 300""")
def long_pending_alerts(s, d):
    t = A.tasks(s, d)
    found = live.long_pending(t, F.lit(NOW).cast("timestamp"), live.missing_dependencies(_needs(s, d), t))
    return found.withColumn("missing", F.array_join(F.array_sort(F.transform("missing", lambda x: x.cast("string"))), ","))


@query(f"""with t as (select id, (1000000 + id % 1000) * 1000000 as created, case when id % 5 <> 0 then (1000000 + id % 1000 + id % 7 * 100) * 1000000 end as started from v_vertices), seen as (select greatest(max(created), max(started)) - 10000000 as mark from t),
    lacking as (select task_id, string_agg(distinct cast(needs as varchar), ',' order by cast(needs as varchar)) as missing from {_NEEDS} where needs not in (select id from v_vertices) and task_id in (select id from v_vertices) group by 1)
    select id as task_id, created + 300000000 as "at", coalesce(missing, '') as missing from t left join lacking on task_id = id where started > created + 300000000 or started is null and (created + 300000000) // 1000 < (select mark // 1000 from seen)""")
def stream_long_pending(s, d):
    folder = new_folder(s)
    v = A.vertices(s, d).select(F.col("id").alias("task_id"))
    at = lambda later: F.timestamp_micros(((F.col("task_id") % 1000 + later + 1_000_000) * 1_000_000).cast("long")).alias("ts")
    created = v.select((2 * F.col("task_id")).alias("event_id"), "task_id", at(F.lit(0)), F.lit("created").alias("kind"))
    started = v.filter("task_id % 5 <> 0").select((2 * F.col("task_id") + 1).alias("event_id"), "task_id", at(F.col("task_id") % 7 * 100), F.lit("started").alias("kind"))
    parts = _in_order(created.unionByName(started).withColumn("us", F.unix_micros("ts")), "us", folder)
    events = s.readStream.schema("event_id long, task_id long, ts timestamp, kind string").parquet(f"{folder}/in/*")
    out = live.with_missing(_run(live.stream_long_pending(events), "append", folder, parts), live.missing_dependencies(_needs(s, d), v))
    return out.select("task_id", "at", F.array_join(F.array_sort(F.transform("missing", lambda x: x.cast("string"))), ",").alias("missing"))


@query("select count_if(status = 'failed') > 0 and count_if(status = 'completed') = 0 as deadlock from v_tasks")
def deadlock_report(s, d):
    state = F.when(F.col("status") == "failed", "pending").when(F.col("status") == "completed", "running").otherwise("other")
    return live.deadlock_report(A.tasks(s, d).groupBy(state.alias("state")).agg(F.count("*").alias("tasks")))


# More columns, reports and graphs


@query("select file_id, path, regexp_replace(path, '^/root/', '') as relative from v_sources where path like '/root/src1%'")
def list_project_files(s, d):
    return A.sources(s, d).filter(F.col("path").startswith("/root/src1")).select("file_id", "path", F.regexp_replace("path", "^/root/", "").alias("relative"))


@query("select file_id from v_sources where not (regexp_matches(text, 'worthless|the moron') or path like '/root/src0/%')")
def exclude_banned_content(s, d):
    return A.sources(s, d).filter(~(F.col("text").rlike("worthless|the moron") | F.col("path").startswith("/root/src0/"))).select("file_id")


@query("select file_id, case file_id % 4 when 0 then 1 when 1 then 2 else 3 end as phase from v_sources")
def file_phase(s, d):
    folder = F.element_at(F.array(*map(F.lit, ("/foundation/", "/middleware/", "/application/", "/tools/"))), (F.col("file_id") % 4 + 1).cast("int"))
    return A.sources(s, d).select("file_id", C.file_phase(F.concat(F.lit("src"), folder, "path")).alias("phase"))


_NAMES = "select p_partkey as id, case p_partkey % 5 when 0 then 'moc_w' || p_partkey || '.cpp' when 1 then 'ui_w' || p_partkey || '.h' when 2 then 'm' || p_partkey || '.pb.cc' when 3 then 'g' || p_partkey || '.tab.c' else 'main' || p_partkey || '.cpp' end as name from part"


def _names(s, d):
    k = F.col("p_partkey").cast("string")
    shapes = (("moc_w", ".cpp"), ("ui_w", ".h"), ("m", ".pb.cc"), ("g", ".tab.c"), ("main", ".cpp"))
    name = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in shapes]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return A.table(s, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))


@query(f"select id, name not like 'main%' as generated, case id % 5 when 0 then 'gen:moc:w' || id || '.h' when 1 then 'gen:uic:w' || id || '.ui' when 2 then 'gen:protoc:m' || id || '.proto' when 3 then 'gen:bison:g' || id || '.y' end as generator from ({_NAMES})")
def infer_generator(s, d):
    return _names(s, d).select("id", C.is_generated("name").alias("generated"), C.infer_generator(F.col("name")).alias("generator"))


@query(f"select name, 'w' || id || '.h' as input from ({_NAMES}) where id % 5 = 0 and id % 3 = 0")
def infer_generated_inputs(s, d):
    files = _names(s, d).filter("id % 3 = 0").select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(".h")).alias("name"))
    return reports.infer_generated_inputs(_names(s, d).select("name"), files)


@query(f"select distinct case id % 5 when 0 then 'gen:moc:w' || id || '.h' when 1 then 'gen:uic:w' || id || '.ui' when 2 then 'gen:protoc:m' || id || '.proto' else 'gen:bison:g' || id || '.y' end as src, id as dst from ({_NAMES}) where id % 5 <> 4")
def generated_edges(s, d):
    return graph.generated_edges(_names(s, d).withColumnRenamed("id", "file_id"), C.infer_generator(F.col("name")))


@query("select file_id, size > 512000 as io_heavy, path like '%/gui/%' as local_only from v_sources")
def is_io_heavy(s, d):
    return A.sources(s, d).select("file_id", C.is_io_heavy(F.col("size"), F.col("path"), F.lit(None).cast("long")).alias("io_heavy"), C.needs_local_only(F.col("path")).alias("local_only"))


@query("select unit_id, '-I inc/a' || (unit_id % 5) || ';' || arguments[4] || ';' || arguments[5] || ';' || arguments[6] as flags, cast(unit_id % 4 as double) as level from v_units")
def extract_flags(s, d):
    return A.units(s, d).select("unit_id", F.array_join(C.extract_flags(F.col("arguments")), ";").alias("flags"), C.optimisation_level(F.col("arguments")).alias("level"))


@query("select file_id, round(size * 1.5 / 1000000, 8) as preprocessed, round(len(regexp_extract_all(text, '(?m)^\\s*#\\s*include\\s*[<\"][^>\"]+[>\"]')) / 50, 6) as includes, 1.5::double as expansion, round(len(string_split(text, chr(10))) / 1000, 6) as lines from v_sources where size > 0")
def compile_features(s, d):
    f = C.compile_features(F.col("text"), F.lit(None).cast("long"), F.array(F.lit("-O2")))
    return A.sources(s, d).select("file_id", *[F.round(F.get(f, F.lit(i)), 8 if i == 0 else 6).alias(n) for i, n in enumerate(("preprocessed", "includes", "expansion", "lines"))])


@query("select file_id, case when file_id % 3 = 0 then 2.5 else greatest(0.1, size / 1024 * 0.001) end as estimate from v_sources")
def fallback_time_estimate(s, d):
    return A.sources(s, d).select("file_id", C.fallback_time(F.when(F.col("file_id") % 3 == 0, 2.5), F.col("size") / 1024).alias("estimate"))


@query("select node_id, round(0.7 * weight + 0.3 * case when node_id % 2 = 0 then 1.5 else 1.0 end, 6) as weight from v_nodes")
def combined_weight(s, d):
    return A.nodes(s, d).select("node_id", F.round(C.combined_weight(F.col("weight"), F.when(F.col("node_id") % 2 == 0, 1.5)), 6).alias("weight"))


@query("select event_id, event_id % 7 as done, event_id % 2 = 0 as ok from events")
def parse_summary_dict(s, d):
    ok = F.when(F.col("event_id") % 2 == 0, "True").otherwise("False")
    line = F.format_string("Summary: {'done': %s, 'ok': %s, 'name': None}", (F.col("event_id") % 7).cast("string"), ok)
    m = C.summary_dict(line)
    return A.table(s, d, "events").select("event_id", F.try_element_at(m, F.lit("done")).cast("long").alias("done"), F.try_element_at(m, F.lit("ok")).cast("boolean").alias("ok"))


@query("select event_id, case when event_id % 3 = 0 then 'local' else '10.0.0.' || (user_id % 250) || ':3632' end as node from events")
def exec_node(s, d):
    host = F.when(F.col("event_id") % 3 == 0, "exec on localhost: g++").otherwise(F.format_string("exec on 10.0.0.%s:3632/8: g++", (F.col("user_id") % 250).cast("string")))
    return A.table(s, d, "events").select("event_id", C.exec_node(host).alias("node"))


@query("select 'h' || (event_id % 20) || '.h' as header, count(*) as failures from events where event_type = 'error' group by 1 order by failures desc, header")
def missing_header_counts(s, d):
    e = A.table(s, d, "events").filter("event_type = 'error'")
    text = F.format_string("a.c:1: fatal error: h%s.h: No such file or directory", (F.col("event_id") % 20).cast("string"))
    return e.select(C.missing_header(text).alias("header")).groupBy("header").agg(F.count("*").alias("failures")).orderBy(F.col("failures").desc(), "header")


@query("with m as (select algo, sum(elapsed) as elapsed, cast(sum(tasks) as double) as tasks from v_run_results group by 1), a as (select * from m where algo = 'A'), b as (select * from m where algo = 'N') select round((a.elapsed - b.elapsed) / a.elapsed * 100, 4) as elapsed, round((a.tasks - b.tasks) / a.tasks * 100, 4) as tasks from a, b")
def compare_summary(s, d):
    m = A.run_results(s, d).groupBy("algo").agg(F.sum("elapsed").alias("elapsed"), F.sum("tasks").cast("double").alias("tasks"))
    return reports.compare_summary(m, "algo", "A", "N", ["elapsed", "tasks"])


@query("""with p as (select machine, sum("end" - start) as busy from v_schedule group by 1) select round((select max("end") - min(start) from v_schedule) + 0.1 * pow(round((select stddev_pop(busy) from p), 4), 2) + 0.05 * (select count(*) from v_edges e join v_schedule a on a.task_id = e.src join v_schedule b on b.task_id = e.dst where a.machine <> b.machine), 2) as score""")
def schedule_score(s, d):
    return reports.schedule_score(schedule_metrics(s, d))


@query("with l as (select conv_id % 10 as host, conv_id % 3 as slot, conv_id as pid, arg_max(turn % 8, turn) as phase, max(turn * 5) as seen from conversations group by 1, 2, 3) select host, slot, pid, phase from l where phase <> 7 and 70 - seen <= 60")
def active_monitor_rows(s, d):
    c = A.table(s, d, "conversations").select((F.col("conv_id") % 10).alias("host"), (F.col("conv_id") % 3).alias("slot"), F.col("conv_id").alias("pid"), (F.col("turn") % 8).alias("phase"), (F.col("turn") * 5).alias("at"))
    return reports.active_monitor_rows(c, F.lit(70), done=7).select("host", "slot", "pid", "phase")


@query("with c as (select node_id, count(*) as tasks from v_tasks group by 1) select slots, cast(sum(tasks) as bigint) as tasks, round(sum(tasks) / sum(slots) * 100, 4) as per_slot_percent from c join v_nodes using (node_id) group by 1")
def node_tier_util(s, d):
    return reports.node_tier_util(A.tasks(s, d).groupBy("node_id").agg(F.count("*").alias("tasks")), A.nodes(s, d))


@query("select algo, case algo when 'R' then 1 when 'A' then 2 else 3 end as place from (select distinct algo from v_run_results)")
def preferred_order(s, d):
    return reports.preferred_order(A.run_results(s, d).select("algo").distinct(), "algo", ["R", "A"]).select("algo", F.col("place").cast("int").alias("place"))


@query("select graph_id, id, row_number() over (partition by graph_id order by weight desc, id) as place from v_vertices")
def priority_order(s, d):
    w = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("weight").desc(), "id"))
    return A.vertices(s, d).select("graph_id", "id", w.cast("long").alias("place"))


@query("select task_id, row_number() over (partition by build_id order by started_us, task_id) as place from v_tasks")
def execution_order(s, d):
    return windows.step_numbers(A.tasks(s, d)).select("task_id", F.col("step").cast("long").alias("place"))


@query("with recursive b as (select src, dst from v_edges union select dst, src from v_edges), r as (select id, id as seen from v_vertices union select r.id, b.dst from r join b on b.src = r.seen), c as (select v.graph_id, v.id, min(seen) as cluster from v_vertices v join r on r.id = v.id group by 1, 2) select graph_id, cluster, count(*) as size from c group by 1, 2 order by size desc, graph_id, cluster limit 10")
def largest_clusters(s, d):
    return graph.largest_clusters(dependency_clusters(s, d))


@query("select distinct graph_id, src as id from v_edges where dst % 50 = 3")
def direct_dependencies(s, d):
    return graph.direct_dependencies(A.edges(s, d), A.vertices(s, d).filter("id % 50 = 3"))


@query("select distinct graph_id, dst as id from v_edges where src % 50 = 3")
def direct_dependents(s, d):
    return graph.direct_dependents(A.edges(s, d), A.vertices(s, d).filter("id % 50 = 3"))


@query(f"with recursive {_LEVELS}, need as (select graph_id, id from v_vertices where id % 90 = 8 union select e.graph_id, e.src from need n join v_edges e on e.dst = n.id) select lev.* from lev where id in (select id from need)")
def task_chain(s, d):
    v = A.vertices(s, d)
    return graph.task_chain(v, A.edges(s, d), v.filter("id % 90 = 8")).withColumn("level", F.col("level").cast("long"))


@query("select v.graph_id, v.id, round(cast(weight * case when id % 7 > 3 then 0.9::double else 1.0::double end * case when (select count(*) from v_edges e where e.dst = v.id) > 5 then 1.15::double else 1.0::double end as double), 6) as priority from v_vertices v")
def priority_adjust(s, d):
    v = A.vertices(s, d)
    return graph.priority_adjust(v.select("graph_id", "id", F.col("weight").alias("priority")), v.select("id", (F.col("id") % 7 / 10).alias("cv")), A.edges(s, d)).withColumn("priority", F.col("priority").cast("double"))


@query("select graph_id, src, dst from v_edges union all select graph_id, id, -1 from v_vertices where node_type = 'compile' and graph_id % 2 = 0")
def add_link_node(s, d):
    v = A.vertices(s, d)
    return graph.add_link_node(v.filter("graph_id % 2 = 1 or node_type <> 'link'"), A.edges(s, d))


@query("select split_part(path, '/', 3) as graph_id, file_id as id, dense_rank() over (partition by split_part(path, '/', 3) order by len(string_split(path, '/'))) - 1 as phase from v_sources")
def path_depth_edges(s, d):
    f = A.sources(s, d).select(F.split_part("path", F.lit("/"), F.lit(3)).alias("graph_id"), F.col("file_id").alias("id"), "path")
    return graph.path_depth_phases(f).withColumn("phase", F.col("phase").cast("long"))


def _with_odd_edges(s, d):
    """Vertices, and edges with one back from each 97th vertex that nothing depends on; such an edge is the weakest of its cycle."""
    v, e = A.vertices(s, d).withColumn("node_type", F.lit("compile")), A.edges(s, d)
    last = e.filter("dst % 97 = 0").join(e.select("graph_id", F.col("src").alias("dst")), ["graph_id", "dst"], "left_anti")
    odd = last.groupBy("graph_id", F.col("dst").alias("src")).agg(F.max("src").alias("dst"))
    kinds = v.join(odd.select("graph_id", F.col("src").alias("id"), F.lit("gen").alias("g")), ["graph_id", "id"], "left").withColumn("node_type", F.coalesce("g", "node_type")).drop("g")
    return kinds, e.unionByName(odd)


#: Edges planted back from sinks to what they need: inferred ones, which go, and source dependencies between compile vertices, which stay.
_SINKS = "last as (select graph_id, dst as src, max(src) as dst from v_edges e where not exists (select 1 from v_edges f where f.src = e.dst) group by 1, 2), firm as (select last.* from last join v_vertices a on a.id = src join v_vertices b on b.id = dst where src % 83 = 0 and a.node_type = 'compile' and b.node_type = 'compile')"


@query(f"with {_SINKS} select e.graph_id, e.src, e.dst, exists (select 1 from firm f where f.src = e.dst and f.dst = e.src) as refused from v_edges e union all select *, true from firm")
def repair_cycles(s, d):
    ends, v, e = ["graph_id", "src", "dst"], A.vertices(s, d), A.edges(s, d)
    sinks = e.join(e.select("graph_id", F.col("src").alias("dst")), ["graph_id", "dst"], "left_anti")
    last = sinks.groupBy("graph_id", F.col("dst").alias("src")).agg(F.max("src").alias("dst"))
    above = last.filter("src % 31 = 0").join(e.groupBy("graph_id", F.col("dst")).agg(F.max("src").alias("far")), ["graph_id", "dst"]).select("graph_id", "src", F.col("far").alias("dst"))
    inferred = last.filter("src % 11 = 0").select(*ends).unionByName(above).join(e, ends, "left_anti").withColumn("relation", F.lit("inferred"))
    units = v.filter("node_type = 'compile'").select("graph_id", "id")
    between = lambda x: x.join(units.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(units.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi").select(*ends)
    source = between(e).withColumn("relation", F.lit("source"))
    plain = e.select(*ends).join(source.select(*ends), ends, "left_anti").withColumn("relation", F.lit(None).cast("string"))
    firm = between(last.filter("src % 83 = 0")).withColumn("relation", F.lit("source"))
    return graph.repair_cycles(v, reduce(DataFrame.unionByName, (firm, inferred.join(firm.select(*ends), ends, "left_anti"), source, plain)))


@query("select graph_id, part as component, count(*) as vertices, min(id) as least from (select graph_id, id, id // 35 as part from v_vertices) group by 1, 2 having count(*) > 1")
def strong_components(s, d):
    """Rings of five vertices of a graph, and edges from every other ring to the next: the rings are what hangs together."""
    v = A.vertices(s, d).select("graph_id", "id", F.floor(F.col("id") / 35).alias("part"))
    w = Window.partitionBy("graph_id", "part").orderBy("id")
    ring = v.select("graph_id", "part", F.col("id").alias("src"), F.coalesce(F.lead("id").over(w), F.min("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("dst"))
    onward = v.filter("part % 2 = 0").groupBy("graph_id", "part").agg(F.max("id").alias("src")).join(v.groupBy("graph_id", (F.col("part") - 1).alias("part")).agg(F.min("id").alias("dst")), ["graph_id", "part"])
    found = graph.strong_components(ring.select("graph_id", "src", "dst").unionByName(onward.select("graph_id", "src", "dst")))
    return found.join(v, ["graph_id", "id"]).groupBy("graph_id", F.col("part").alias("component")).agg(F.count("*").alias("vertices"), F.min("component").alias("least"))


@query("select event_id as n, case when event_id % 100 = 99 then 'DONE' else 'STALLED' end as alert from events where event_id % 100 = 99 or event_id % 100 between 10 and 49 or event_id % 100 between 60 and 98")
def stall_and_done_alerts(s, d):
    e = A.table(s, d, "events")
    half = (F.col("event_id") % 100 >= 50).cast("int")
    snaps = e.select(F.floor(F.col("event_id") / 100).alias("build_id"), F.col("event_id").alias("n"), half.alias("started"), F.when(F.col("event_id") % 100 == 99, 10).otherwise(half).alias("finished"), F.lit(10).alias("total"), F.lit(0).alias("waiting"))
    return reports.stall_and_done(snaps).select("n", "alert")


#: The model of each node: time explained by two features, the system of two equations solved by its determinant.
_MODEL = """r as (select l_suppkey as node_id, cast(l_quantity as double) as a, cast(l_linenumber as double) as b, cast(l_extendedprice as double) as y, 1 - 0.01::double * (row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1) as w from lineitem),
    s as (select node_id, count(*) as n, sum(w) as w, sum(w * a * a) + 0.01::double as aa, sum(w * a * b) as ab, sum(w * b * b) + 0.01::double as bb, sum(w * a * y) as ay, sum(w * b * y) as b_y, sum(w * a) as a, sum(w * b) as b, sum(w * y) as y from r where w > 0.005 group by 1 having count(*) >= 3),
    c as (select *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) as c1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) as c2 from s), model as (select node_id, n, c1, c2, (y - c1 * a - c2 * b) / w as bias from c)"""


def _model(s, d):
    li = A.table(s, d, "lineitem").withColumnRenamed("l_suppkey", "node_id")
    return models.fit_compile_model(li, "node_id", ["l_quantity", "l_linenumber"], "l_extendedprice", [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query(f"with {_MODEL} select node_id, n, round(c1, 4) as c1, round(c2, 4) as c2, round(bias, 4) as bias from model")
def fit_compile_model(s, d):
    c = lambda i: F.round(F.get("coefficients", F.lit(i)), 4).alias(f"c{i + 1}")
    return _model(s, d).select("node_id", "n", c(0), c(1), F.round("bias", 4).alias("bias"))


@query(f"with {_MODEL} select node_id, round(greatest(c1 * (node_id % 5 - 2) + c2 * 3.0::double + bias, 0.1::double), 4) as seconds from v_nodes join model using (node_id)")
def predict_compile_time(s, d):
    f = F.array((F.col("node_id") % 5 - 2).cast("double"), F.lit(3.0))
    return A.nodes(s, d).join(_model(s, d), "node_id").select("node_id", F.round(models.predict_compile_time(F.col("coefficients"), F.col("bias"), f), 4).alias("seconds"))


@query(f"with {_STREAM}, w as (select node_id, (us // 300000000 + k) * 300 as upto from st, generate_series(1, 3) g(k)) select node_id, cast(upto as bigint) as \"at\", count(*) as compiles from w group by node_id, upto having upto * 1000000 < (select max(us) - 600000000 from st)")
def stream_sliding_totals(s, d):
    out = _drained(s, d, live.stream_sliding_totals, "append")
    return out.select("node_id", (F.unix_micros("at") / 1_000_000).cast("long").alias("at"), "compiles").filter(F.col("at") * 1_000_000 < F.lit(_latest(s, d) - 600_000_000))


def _latest(s, d) -> int:
    return A.table(s, d, "events").select(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]


#: Heartbeats of fifty nodes: the events' month in three quarters of an hour, so that seconds of silence come about.
_BEATS = f"b as (select event_id, us // 1000 as us, node_id % 50 as node_id, kind from (with {_STREAM} select * from st)), seen as (select max(us) - 10000000 as mark from b)"
_SESSIONS = f"{_BEATS}, g as (select *, case when us - lag(us) over w {{}} 30000000 then 0 else 1 end as new from b window w as (partition by node_id order by us, event_id)), s as (select *, sum(new) over (partition by node_id order by us, event_id rows unbounded preceding) as k from g)"


def _beats(s, d) -> DataFrame:
    return _events(s, d).select("event_id", F.timestamp_micros(F.floor(F.unix_micros("ts") / 1000).cast("long")).alias("ts"), (F.col("node_id") % 50).alias("node_id"), "kind", "value")


@query(f"with {_SESSIONS.format('<')} select node_id, count(*) as beats, min(us) as since from s group by node_id, k having max(us) + 30000000 <= (select mark from seen)")
def stream_heartbeat_sessions(s, d):
    return _drained(s, d, live.stream_heartbeat_sessions, "append", _beats(s, d)).select("node_id", "beats", F.unix_micros("since").alias("since"))


@query(f"""with {_SESSIONS.format('<=')}, d as (select *, sum(case kind when 'scheduled' then 1 else -1 end) over (partition by node_id, k order by us, event_id rows unbounded preceding) as n from s),
    l as (select *, n - least(0, min(n) over (partition by node_id, k order by us, event_id rows unbounded preceding)) as load from d), t as (select *, case when load >= 2 then 'BUSY' else 'ONLINE' end as status from l),
    c as (select *, lag(status) over w as before, lead(us) over w as next_us from t window w as (partition by node_id, k order by us, event_id)), e as (select node_id, k, max(us) + 30000000 as "at", arg_max(load, (us, event_id)) as load from t group by 1, 2)
    select node_id, us as "at", status, cast(load as bigint) as load from c where before is distinct from status
    union all select node_id, "at", 'OFFLINE', cast(load as bigint) from e where k < (select max(k) from e x where x.node_id = e.node_id) or "at" // 1000 + 1 < (select mark // 1000 from seen)""")
def stream_node_state(s, d):
    return _drained(s, d, lambda e: live.stream_node_state(e, slots=2), "append", _beats(s, d)).drop("batch")


@query(f"""with {_BEATS}, f as (select *, lead(us) over w as next_us, lead(kind) over w as next_kind from b where kind in ('failed', 'completed') window w as (partition by node_id order by us, event_id))
    select node_id, us as "at", 'EXCLUDED' as state from f where kind = 'failed'
    union all select node_id, next_us, 'CLEARED' from f where kind = 'failed' and next_kind = 'completed' and next_us < us + 60000000
    union all select node_id, us + 60000000, 'EXPIRED' from f where kind = 'failed' and (next_us >= us + 60000000 or next_us is null and (us + 60000000) // 1000 < (select mark // 1000 from seen))""")
def stream_backoff(s, d):
    return _drained(s, d, live.stream_backoff, "append", _beats(s, d)).drop("batch")


@query("select dst as consumer, count(*) as producers from v_edges group by 1")
def stream_release_ready(s, d):
    folder = new_folder(s)
    e = A.edges(s, d)
    rows = e.join(e.groupBy("dst").agg(F.count("*").alias("needs")).hint("merge"), "dst").select(F.lit(NOW).cast("timestamp").alias("ts"), F.col("dst").alias("consumer"), "needs", "src")
    parts = _in_order(rows, "src", folder)
    stream = s.readStream.schema("ts timestamp, consumer long, needs long, src long").parquet(f"{folder}/in/*")
    return _run(live.stream_release_ready(stream), "append", folder, parts).drop("batch")


@query("select event_type as kind, count(*) as events from events group by 1")
def stream_status_snapshots(s, d):
    """Snapshots of a stream, one a micro-batch and each in a folder of its own, so that a batch run again replaces its own; then their sums."""
    folder = new_folder(s)
    parts = _in_order(A.table(s, d, "events").select(F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "us", folder)
    stream = s.readStream.schema("kind string").parquet(f"{folder}/in/*")
    s.createDataFrame([], "kind string, events long").write.parquet(f"{folder}/out/batch=-1")
    _start(stream, "append", folder, parts, lambda rows, n: live.status_snapshot(rows, n).drop("batch").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return s.read.schema("kind string, events long, batch long").parquet(f"{folder}/out").groupBy("kind").agg(F.sum("events").alias("events"))
