"""Build-telemetry views over the driver's tables, for Spark; ``views`` has the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compile task for each event."""
    e = _events(spark, sf_dir)
    done = F.unix_micros("ts")
    started = done - F.round(F.col("value") * 60_000_000).cast("long")
    scheduled = started - F.col("event_id") % 60 * 1_000_000
    return e.select(
        F.col("event_id").alias("task_id"),
        F.col("user_id").alias("node_id"),
        F.concat(F.lit("f"), (F.col("event_id") % 500).cast("string")).alias("file"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "cancelled").otherwise("completed").alias("status"),
        F.timestamp_micros(scheduled - F.col("event_id") % 7 * 1_000_000).alias("created_at"),
        F.when(F.col("event_id") % 50 != 0, F.timestamp_micros(scheduled)).alias("scheduled_at"),
        F.timestamp_micros(started).alias("started_at"),
        F.col("ts").alias("completed_at"),
        (F.col("event_id") % 8).alias("algorithm"),
        F.date_format("ts", "yyyy-MM-dd").alias("build_id"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduling decision for each task, and a retry for every tenth."""
    e = _events(spark, sf_dir)
    first = e.select(F.col("event_id").alias("task_id"), F.col("user_id").alias("node_id"), (F.col("event_id") % 8).alias("algorithm"), (F.col("event_id") % 100 / 100).alias("confidence"), F.col("ts").alias("decided_at"), F.col("props").alias("factors"), F.lit(1).alias("attempt"))
    again = first.filter("task_id % 10 = 0").withColumn("attempt", F.lit(2)).withColumn("decided_at", F.col("decided_at") + F.expr("interval 1 second"))
    return first.unionByName(again)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("node_id"),
        F.col("s_name").alias("hostname"),
        F.when(k == 0, 8).when(k == 1, 4).otherwise(2).alias("slots"),
        F.when(k == 0, 2.0).when(k == 1, 1.0).otherwise(0.5).alias("weight"),
        (F.floor(F.abs("s_acctbal")) % 300).cast("long").alias("latency_ms"),
    )


def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("node_id"), (F.floor("value") % 100).cast("long").alias("cpu"), (F.col("event_id") % 97).alias("memory"), (F.col("event_id") % 9).alias("load"), F.col("ts").alias("at"))


def server_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in (("click", "COMPILE_OK"), ("error", "COMPILE_ERROR"), ("view", "TCP_ACCEPT"), ("signup", "REJ_OVERLOAD"), ("purchase", "COMPILE_TIMEOUT")) for x in pair])
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("node_id"), kind[F.col("event_type")].alias("kind"), F.col("ts").alias("stopped_at"), F.timestamp_micros(F.unix_micros("ts") - F.round(F.col("value") * 1_000_000).cast("long")).alias("started_at"), F.col("value").alias("seconds"), F.concat(F.lit("f"), (F.col("event_id") % 500).cast("string")).alias("file"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduler log lines, so that parsing meets real text."""
    e = _events(spark, sf_dir)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format("ts", "SSS"))
    task, node = F.concat(F.lit("compile:f"), F.col("event_id").cast("string")), F.concat(F.lit("node"), F.col("user_id").cast("string"))
    body = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Task "), task, F.lit(" completed in "), F.format_string("%.2f", "value"), F.lit("s on "), node))
        .when(F.col("event_type") == "error", F.concat(F.lit("Task "), task, F.lit(" failed: exit code "), (F.col("event_id") % 4).cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Task "), task, F.lit(" scheduled to "), node))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Task "), task, F.lit(" started on "), node))
        .otherwise(F.concat(F.lit("Heartbeat from "), node))
    )
    return e.select(F.col("event_id").alias("line_no"), F.concat(stamp, F.lit(" - scheduler - INFO - "), body).alias("line"))


def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("backend"), F.col("l_partkey").alias("file")).agg(F.round(F.avg("l_quantity"), 6).alias("seconds"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("algo"), F.col("l_linestatus").alias("run"), F.col("l_suppkey").alias("node")).agg(F.count("*").alias("tasks"), F.round(F.sum("l_quantity"), 2).alias("elapsed"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("l_linestatus").alias("mode"), F.col("p_brand").alias("module"), F.col("l_partkey").alias("file"), (F.col("l_returnflag") == "R").alias("failed"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("compile", "link", "gen", "compile", "compile"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("graph_id"), F.col("p_partkey").alias("id"), kind.alias("node_type"), F.col("p_size").cast("long").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer to consumer: each vertex depends on two smaller ones of its graph, so that there is no cycle."""
    v = vertices(spark, sf_dir).select("graph_id", F.col("id").alias("dst"), F.floor(F.col("id") / 7).cast("long").alias("j")).filter("j >= 1")
    parents = v.select("graph_id", "dst", F.explode(F.array_distinct(F.array(7 * F.floor(F.col("j") / 2) + F.col("graph_id"), 7 * F.floor(F.col("j") / 3) + F.col("graph_id")))).alias("src"))
    return parents.filter("src <> dst").select("graph_id", F.col("src").cast("long").alias("src"), "dst")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("task_id"), (k % 10).alias("machine"), (k * 3 % 1000).alias("start"), (k * 3 % 1000 + F.col("p_size")).cast("long").alias("end"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: each document's text under include lines for two earlier ones."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    head = F.concat(F.lit('#include "d'), F.floor(i / 2).cast("string"), F.lit('.h"\n#include <d'), F.floor(i / 3).cast("string"), F.lit(".h>\n"))
    path = F.concat(F.lit("/root/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), i.cast("string"), F.lit(".cpp"))
    return d.select(i.alias("file_id"), path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text")).withColumn("size", F.octet_length("text").cast("long"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header files; one name may lie in several folders."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    at = lambda keep, *parts: d.filter(keep).select(i.alias("file_id"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (*parts, i.cast("string"), ".h")]).alias("path"))
    kinds = ((i % 3 != 2, "/root/inc/", F.col("lang"), "/d"), (i % 4 == 0, "/root/", F.col("source"), "/", F.col("lang"), "/near/d"), (i % 5 == 0, "/root/common/d"), (i % 2 == 0, "/root/inc/", F.col("lang"), "/sub/n"), (i % 3 == 0, "/root/common/sub/n"))
    return reduce(DataFrame.unionByName, (at(*k) for k in kinds))


def includers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that include a path and two bare names, with their search folders."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    part = lambda k: F.floor(i / k).cast("string")
    head = F.concat(F.lit('#include "sub/n'), part(4), F.lit('.h"\n#include "d'), part(2), F.lit('.h"\n#include <d'), part(3), F.lit(".h>\n"))
    path = F.concat(F.lit("/root/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), i.cast("string"), F.lit(".cpp"))
    own = F.concat(F.lit("/root/inc/"), F.col("lang"))
    search = F.when(i % 2 == 0, F.array(F.lit("/root/common"), own)).otherwise(F.array(own, F.lit("/root/inc/en"), F.lit("/root/common")))
    return d.select(i.alias("file_id"), path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"), search.alias("search"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compile units with argument lists."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    s = k.cast("string")
    ext = F.element_at(F.array(*map(F.lit, (".c", ".cpp", ".cu", ".cc"))), (k % 4 + 1).cast("int"))
    file = F.concat(F.lit("src/m"), (k % 20).cast("string"), F.lit("/f"), s, ext)
    args = F.array(F.lit("g++"), F.lit("-I"), F.concat(F.lit("inc/a"), (k % 5).cast("string")), F.concat(F.lit("-Iinc/b"), (k % 3).cast("string")), F.concat(F.lit("-DX="), F.col("p_size").cast("string")), F.concat(F.lit("-O"), (k % 4).cast("string")), F.lit("-c"), file, F.lit("-o"), F.concat(F.lit("out/f"), s, F.lit(".o")))
    return p.select(k.alias("unit_id"), F.concat(F.lit("/root/w"), (k % 3).cast("string")).alias("directory"), file.alias("file"), args.alias("arguments"))


def session_lines(s: SparkSession, d: str) -> DataFrame:
    """A line of a session's log for each event, in the form that its type has."""
    e = table(s, d, "events")
    node = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    task = F.concat(F.lit("ccdb_"), F.col("event_id").cast("string"))
    seconds = F.format_string("%.2f", F.col("event_id") % 900 / 100)
    reason = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("exit "), (F.col("event_id") % 4).cast("string"))).otherwise(" ")
    form = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("CompilationTracker - INFO - unit Completed f.cpp in "), seconds, F.lit("s")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Scheduled task "), task, F.lit(" to node "), node))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Task "), task, F.lit(" scheduled for execution")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Task "), task, F.lit(" started on node "), node))
        .when(F.col("event_type") == "error", F.concat(F.lit("Task "), task, F.lit(" failed: "), reason))
        .otherwise("nothing of note")
    )
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("2024-01-01 00:00:00,000 - "), form).alias("line"))
