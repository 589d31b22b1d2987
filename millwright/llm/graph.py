"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import removed, shared_dir, written


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Ties the neighbours of each node that ``keep`` admits to the smallest of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst long), the component being its smallest node.

    Each round is two aggregations by node, each joined back, so that a hub is pre-aggregated and its join can be split.
    The edge set stays linear.  Rounds are written to the shared folder, each in place of the one before, and end when every node hangs on its component.
    """
    folder = shared_dir(edges.sparkSession)
    now = written(edges.filter("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), folder=f"{folder}/0")
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).filter("u <> v").distinct()
        small = _star(large, F.lit(True)).unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).filter("u <> v").distinct()
        new = written(small, folder=f"{folder}/{k}")
        roots = new.select(F.col("v").alias("u")).distinct()
        settled = new.join(roots, "u", "left_semi").isEmpty() and new.groupBy("u").count().filter("count > 1").isEmpty()
        now = new
        removed(edges.sparkSession, f"{folder}/{k - 1}")
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
