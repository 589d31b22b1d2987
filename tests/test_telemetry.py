"""Recorded tables from files and, in ranges of time, from a database inside the test's JVM."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.plans import adapters as A
from millwright.sources import readers, writers
from millwright.sources.shared import new_folder


def _fixed(name: str = "task_executions") -> T.StructType:
    return T.StructType.fromDDL(readers.TELEMETRY[name])


def _executions(spark, sf_dir):
    """Tasks under the recorded names; one in seven has no time of creation."""
    tasks = A.tasks(spark, sf_dir).withColumn("created_at", F.when(F.col("task_id") % 7 != 0, F.col("created_at"))).withColumnsRenamed({"file": "source_file", "algorithm": "algorithm_used"})
    return tasks.select(*[(F.col(f.name) if f.name in tasks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fixed()])


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


@pytest.fixture(scope="module")
def executions(spark, sf_dir, url):
    rows = _executions(spark, sf_dir)
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="task_executions", createTableColumnTypes="task_id varchar(40), status varchar(20), node_id varchar(40)").save()
    return rows


def test_ranges_of_time_hold_every_row_once(spark, url, executions):
    found = readers.load_telemetry_jdbc(spark, url, "task_executions", parts=5)
    assert found.schema.simpleString() == _fixed().simpleString()
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, executions.collect()), key=repr)
    held = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(held) == 5  # no range took all


def test_bounds_and_filters_reach_the_database(spark, url, executions):
    found = readers.load_telemetry_jdbc(spark, url, "task_executions", parts=4, since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
    expected = executions.filter("created_at >= timestamp'2024-01-05' and created_at < timestamp'2024-01-20'")
    assert {r["task_id"] for r in found.collect()} == {r["task_id"] for r in expected.collect()}
    failed = readers.load_telemetry_jdbc(spark, url, "task_executions", parts=4).filter("status = 'failed'").select("task_id")
    plan = failed._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,failed)" in plan and "execution_time" not in plan
    assert {r["task_id"] for r in failed.collect()} == {r["task_id"] for r in executions.filter("status = 'failed'").collect()}


def test_empty_tables_and_one_instant(spark, url, executions):
    empty = spark.createDataFrame([], _fixed("diagnostics"))
    empty.write.format("jdbc").options(url=url, dbtable="notes").save()
    assert readers.load_telemetry_jdbc(spark, url, "diagnostics", dbtable="notes").collect() == []
    one = spark.sql("select timestamp'2024-01-01 00:00:00' as timestamp, 'a' as diagnostic_type, '{}' as data from range(3)")
    one.write.mode("append").format("jdbc").options(url=url, dbtable="notes").save()
    assert readers.load_telemetry_jdbc(spark, url, "diagnostics", dbtable="notes").count() == 3


@pytest.mark.parametrize("fmt", ("parquet", "csv", "json"))
def test_files_give_back_what_was_written(spark, sf_dir, fmt):
    rows = _executions(spark, sf_dir)
    writers.write_telemetry(rows, path := new_folder(spark), "completed_at", fmt)
    found = readers.load_telemetry(spark, path, "task_executions", fmt)
    assert found.columns == [*_fixed().names, "event_date"]
    assert sorted(map(tuple, found.drop("event_date").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
