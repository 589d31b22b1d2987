"""Writers of telemetry, reports and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_telemetry(rows: DataFrame, path: str, at: str, fmt: str = "parquet") -> None:
    """Appends rows, in a folder for each day of ``at``; text formats keep microseconds, and CSV files begin with the names."""
    days = rows.withColumn("event_date", F.to_date(at)).write.mode("append").partitionBy("event_date").format(fmt)
    if fmt in ("csv", "json"):
        days = days.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    days.save(path)


def newest(df: DataFrame, at: str, tie: str, n: int = 1000) -> DataFrame:
    """The newest rows; each partition keeps its own best before they meet."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def export_recent(df: DataFrame, path: str, at: str, tie: str, n: int = 1000) -> None:
    newest(df, at, tie, n).write.mode("overwrite").json(path)


def joined_export(tasks: DataFrame, decisions: DataFrame, n: int = 1000) -> DataFrame:
    """The newest tasks with their decisions, one row for each decision."""
    rows = tasks.join(decisions.select("task_id", "confidence", "attempt"), "task_id", "left")
    return rows.orderBy(F.col("created_at").desc(), F.col("task_id").desc(), F.col("attempt").desc_nulls_last()).limit(n)


def export_joined(tasks: DataFrame, decisions: DataFrame, path: str, n: int = 1000) -> None:
    joined_export(tasks, decisions, n).write.mode("overwrite").option("header", True).csv(path)


def apply_retention(tables: dict[str, tuple[DataFrame, str]], cutoff: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows at or after the cutoff of each table, and how many each loses; a null time keeps its row."""
    kept, lost = {}, None
    for name, (df, at) in tables.items():
        old = F.coalesce(F.col(at) < cutoff, F.lit(False))
        kept[name] = df.filter(~old)
        one = df.agg(F.count_if(old).alias("removed")).select(F.lit(name).alias("table"), "removed")
        lost = one if lost is None else lost.unionByName(one)
    return kept, lost


def edges_dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph: a coloured, labelled node for each vertex, an arrow for each edge."""
    colour = F.when(F.col("node_type") == "compile", "lightblue").when(F.col("node_type") == "link", "orange").when(F.col("node_type") == "gen", "lightgreen").otherwise("grey")
    points = vertices.select(F.format_string('"%s" [label="%s", fillcolor="%s"];', F.col("id").cast("string"), F.col("id").cast("string"), colour).alias("value"))
    return points.unionByName(edges.select(F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")))


def export_edges_dot(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    edges_dot(vertices, edges).write.mode("overwrite").text(path)


def write_run_results(runs: DataFrame, folder: str, *, without_time: Column | None = None) -> None:
    """<algo>_run<k>_time.txt and <algo>_run<k>_distribution.json of each run (algo, run, elapsed, distribution, total), written by the tasks."""
    has_time = F.lit(True) if without_time is None else ~without_time
    name = F.concat(F.col("algo"), F.lit("_run"), F.col("run").cast("string"))
    time = runs.filter(has_time).select(F.concat(name, F.lit("_time.txt")).alias("name"), F.concat(F.lit("real "), F.col("elapsed").cast("string"), F.lit("\n")).alias("value"))
    spread = runs.select(F.concat(name, F.lit("_distribution.json")).alias("name"), F.to_json(F.struct("distribution", F.col("total").alias("total_tasks"))).alias("value"))
    time.unionByName(spread).repartition("name").write.partitionBy("name").text(folder)
