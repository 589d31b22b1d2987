"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own, as in tests, and any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-millwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder there."""
    return f"{shared_root(spark)}/millwright-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of which nothing is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def moved(spark: SparkSession, folder: str, to: str) -> bool:
    """Gives a folder another name at once; False where there is none."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, to))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(old) and files.rename(old, new)


def cut_lineage(df: DataFrame, *, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: plans start anew there, with nothing of what loops have inferred about columns.

    ``instead_of``, a table that this function gave and that is read no more, is deleted.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.table_path = path
    if instead_of is not None:
        removed(spark, instead_of.table_path)
    return found
