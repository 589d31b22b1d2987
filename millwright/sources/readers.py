"""Readers of build data: compile databases, host lists, dependency files, makefiles, logs, run results, status pages, telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPILE_DB = T.StructType().add("directory", "string").add("command", "string").add("arguments", T.ArrayType(T.StringType())).add("file", "string").add("output", "string")
#: Columns of the recorded tables.
TELEMETRY = {
    "task_executions": "task_id string, source_file string, output_file string, node_id string, algorithm_used string, status string, return_code int, created_at timestamp, scheduled_at timestamp, started_at timestamp, completed_at timestamp, queue_time double, execution_time double, preprocessing_time double, compilation_time double, transfer_time double, stdout string, stderr string",
    "scheduling_decisions": "task_id string, selected_node_id string, algorithm_used string, confidence_score double, decision_time timestamp, decision_factors string, alternative_nodes string",
    "node_performance": "node_id string, hostname string, timestamp timestamp, cpu_usage double, memory_usage double, load_average double, current_load int, network_latency double, status string, success_rate double, avg_compile_time double, total_tasks int",
    "scheduler_statistics": "timestamp timestamp, period_start timestamp, period_end timestamp, total_tasks int, completed_tasks int, failed_tasks int, statistics string",
    "diagnostics": "timestamp timestamp, diagnostic_type string, data string",
    "status_updates": "timestamp timestamp, queue_stats string, cluster_stats string, scheduler_stats string, running_tasks int, ready_tasks int",
}

#: The time of a recorded row, by which tables are cut into ranges.
TELEMETRY_AT = {"task_executions": "created_at", "scheduling_decisions": "decision_time"} | dict.fromkeys(("node_performance", "scheduler_statistics", "diagnostics", "status_updates"), "timestamp")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_compile_db(spark: SparkSession, path: str) -> DataFrame:
    """Units of a compile database: directory, arguments, file, output; C and C++ sources only; a command is split at spaces."""
    units = spark.read.schema(COMPILE_DB).option("multiLine", True).json(path)
    return units.filter(F.col("file").rlike(r"\.(c|cpp|cc|cxx|C)$")).select("directory", F.coalesce("arguments", F.split(F.trim("command"), r"\s+")).alias("arguments"), "file", "output")


def read_log_lines(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(ts, line) of the lines that begin with a stamp, between start and end."""
    stamp = F.try_to_timestamp(F.substring("value", 1, 23), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    found = _lines(spark, path).select(stamp.alias("ts"), F.col("value").alias("line")).filter("ts is not null")
    if start is not None:
        found = found.filter(F.col("ts") >= start)
    return found if end is None else found.filter(F.col("ts") <= end)


def read_hosts(spark: SparkSession, path: str, *, port: int = 3632) -> DataFrame:
    """host, port, slots (null where not given) and options of host lines; blanks and comments are left out."""
    spec = _lines(spark, path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).filter("v <> ''").select(F.explode(F.split("v", r"\s+")).alias("v"))
    part = lambda pattern: F.nullif(F.regexp_extract("v", pattern, 1), F.lit(""))
    options = F.filter(F.split(F.regexp_extract("v", r"^[^,]*(,.*)?$", 1), ","), lambda o: o != "")
    return spec.select(part(r"^([^:/,]+)").alias("host"), F.coalesce(part(r"^[^:/,]+:(\d+)").cast("int"), F.lit(port)).alias("port"), part(r"^[^/,]+/(\d+)").cast("int").alias("slots"), options.alias("options"))


def cluster_capacity(hosts: DataFrame) -> DataFrame:
    """Summed slots, one for a host that names none."""
    return hosts.agg(F.coalesce(F.sum(F.coalesce("slots", F.lit(1))), F.lit(0)).alias("capacity"))


def read_dep_files(spark: SparkSession, path: str) -> DataFrame:
    """(target, dependency) of dependency files, continued lines joined, system paths left out."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\\\r?\n", " "), r"\r?\n")).alias("rule")).filter(F.col("rule").contains(":"))
    target = F.trim(F.regexp_extract("rule", r"^([^:]+):", 1))
    deps = F.filter(F.split(F.regexp_replace("rule", r"^[^:]+:", ""), r"\s+"), lambda d: (d != "") & ~d.startswith("/usr/") & ~d.startswith("/opt/"))
    return whole.select(target.alias("target"), F.explode(deps).alias("dependency"))


def read_makefile_rules(spark: SparkSession, path: str) -> DataFrame:
    """(target, dependencies) of a makefile; of several rules for a target the last counts."""
    rule = r"^([^\s:=#][^:=]*):(?!=)(.*)$"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).filter(F.col("line").rlike(rule))
    parsed = lines.select("n", F.trim(F.regexp_extract("line", rule, 1)).alias("target"), F.filter(F.split(F.regexp_extract("line", rule, 2), r"\s+"), lambda d: d != "").alias("dependencies"))
    return parsed.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.col("n").desc()))).filter("r = 1").select("target", "dependencies")


def makefile_sources(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sources that a makefile names, with their objects."""
    found = _lines(spark, path).select(F.explode(F.regexp_extract_all("value", F.lit(r"([\w./+-]+\.(?:cpp|cc|cxx|c))\b"), F.lit(1))).alias("file")).distinct()
    return found.select("file", F.regexp_replace("file", r"\.\w+$", ".o").alias("object"))


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """algo, run, elapsed, distribution and total of a folder's <algo>_run<k>_time.txt and <algo>_run<k>_distribution.json; runs without either are left out.

    A name may be a file's or, as tasks write them, that of a folder ``name=...`` with the file.
    """
    name = lambda suffix: [F.regexp_extract(F.input_file_name(), rf"([^/=]+)_run\d+_{suffix}", 1).alias("algo"), F.regexp_extract(F.input_file_name(), rf"_run(\d+)_{suffix}", 1).cast("int").alias("run")]
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    times = whole.filter(F.input_file_name().contains("_time.txt")).select(*name(r"time\.txt"), F.regexp_extract("value", r"([\d.]+)", 1).try_cast("double").alias("elapsed"))
    kind = T.StructType().add("distribution", T.MapType(T.StringType(), T.LongType())).add("total_tasks", "long")
    spread = whole.filter(F.input_file_name().contains("_distribution.json")).select(*name(r"distribution\.json"), F.from_json("value", kind).alias("x"))
    return times.join(spread.select("algo", "run", "x.distribution", F.col("x.total_tasks").alias("total")), ["algo", "run"])


def read_task_order_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pipe table of nine cells or more: cells and whether a check mark says success."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = _lines(spark, path).filter(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select(cells.alias("cells"), F.col("value").contains("✓").alias("success"))
    return rows.filter((F.size("cells") >= 9) & F.get("cells", F.lit(0)).rlike(r"^\d+$"))


def read_bench_summary(spark: SparkSession, path: str) -> DataFrame:
    """algo, elapsed, port and count of a free-text summary: a heading for each algorithm, then its time and ports."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?====)")).alias("part")).filter(F.col("part").rlike("^==="))
    each = whole.select(F.regexp_extract("part", r"^=+\s*([\w-]+)", 1).alias("algo"), F.regexp_extract("part", r"(?i)time:?\s*([\d.]+)", 1).cast("double").alias("elapsed"), F.explode(F.regexp_extract_all("part", F.lit(r"port\s+\d+:\s*\d+"), F.lit(0))).alias("p"))
    return each.select("algo", "elapsed", F.regexp_extract("p", r"port\s+(\d+)", 1).cast("int").alias("port"), F.regexp_extract("p", r":\s*(\d+)", 1).cast("long").alias("tasks"))


def read_stats_page(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """One row a page of "key value" lines, the named fields as doubles.

    A file may hold many pages, each up to its end tag (``</distccstats>``); what follows the last one is no page.  A file without
    such a tag is one page.  A file is read whole, so keep it to some tens of megabytes.
    """
    pairs = F.transform(F.filter(F.split("page", "\n"), lambda s: s.rlike(r"^\s*[\w.]+\s+[-\d.]+\s*$")), lambda s: F.struct(F.regexp_extract(s, r"^\s*([\w.]+)", 1).alias("k"), F.regexp_extract(s, r"([-\d.]+)\s*$", 1).alias("v")))
    parts = F.split("value", "</distccstats>")
    pages = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    page = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.explode(pages).alias("page")).select(F.map_from_entries(pairs).alias("m"))
    return page.select(*[F.try_element_at("m", F.lit(f)).cast("double").alias(f) for f in fields])


def load_telemetry(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A recorded table from Parquet, CSV or JSON, with its fixed columns; empty CSV cells are null.  A table in folders for each day has event_date as well."""
    reader = spark.read.schema(TELEMETRY[name])
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def load_telemetry_jdbc(spark: SparkSession, url: str, name: str, *, dbtable: str | None = None, parts: int = 64, since: str | None = None, until: str | None = None, quote: str = '"', options: dict[str, str] | None = None) -> DataFrame:
    """A recorded table from a database, there under ``dbtable`` or its own name, with its fixed columns, read by up to ``parts`` tasks at a time.

    Each task asks for one range of the table's time (``TELEMETRY_AT``); the bounds come from the least and greatest time, which
    the database finds, within [since, until) if given.  Rows without a time are read by the first range, unless a bound leaves
    them out.  Filters on the result reach the database; only columns that are used are fetched.  An empty table gives an empty one.
    """
    stored = dbtable or name
    at = f"{quote}{TELEMETRY_AT[name]}{quote}"
    wanted = [f"{at} >= '{since}'"] * (since is not None) + [f"{at} < '{until}'"] * (until is not None)
    where = " where " + " and ".join(wanted) if wanted else ""
    source = lambda what: spark.read.format("jdbc").options(url=url, dbtable=what, **(options or {}))
    span = source(f"(select min({at}) as lo, max({at}) as hi from {stored}{where}) x").load().toDF("lo", "hi")
    low, high = span.select(F.col("lo").cast("string"), F.col("hi").cast("string")).first()
    rows = source(f"(select * from {stored}{where}) x" if where else stored).option("customSchema", TELEMETRY[name])
    if low is not None and low < high:
        rows = rows.options(partitionColumn=TELEMETRY_AT[name], lowerBound=low, upperBound=high, numPartitions=parts)
    return rows.load().select(*T.StructType.fromDDL(TELEMETRY[name]).names)
