"""Places, running sums and neighbours in ordered groups, of which one may hold most of the rows.

A window over a group puts the group into one task.  Here rows are dealt out by range of (group, order), so a busy group lies in
many parts; windows run inside parts, and a small table of one row for each (group, part) says what the parts before add.  A
group has as many parts as there are tasks at most.  A null key is a group of its own, as in windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.sources.shared import cut_lineage


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the rest of the row of ``right`` that has their keys; null equals null; without keys, ``right`` is one row."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def in_order(df: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, of each row's group by ``order``: __i its place from 1, __n the group's size, and what is asked for by name.

    sums: total of a value up to the row (nulls count as 0); lasts: its latest known value up to the row; before, after: its value
    in the row before or after, null at the ends.  Nulls come first in order; rows that ``order`` does not part share no fixed
    order, so it should end in a unique column.  An empty table gives an empty one.
    """
    sums, lasts, before, after = sums or {}, lasts or {}, before or {}, after or {}
    kept = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__s_{k}") for k, c in sums.items()], *[c.alias(f"__l_{k}") for k, c in lasts.items()], F.struct(F.lit(0), *[c.alias(k) for k, c in before.items()]).alias("__b"), F.struct(F.lit(0), *[c.alias(k) for k, c in after.items()]).alias("__a"))
    parts = cut_lineage(kept.repartitionByRange(*keys, *order).withColumn("__group", F.struct(*keys, F.spark_partition_id().alias("__part"))))

    spot = F.struct(*order)
    held = parts.groupBy("__group").agg(
        F.count("*").alias("__rows"),
        *[F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums],
        *[F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), spot)).alias(f"__l_{k}") for k in lasts],
        F.max_by("__b", spot).alias("__b"),
        F.min_by("__a", spot).alias("__a"),
    )
    group = Window.partitionBy(*[F.col("__group").getField(k) for k in keys])
    by_part = group.orderBy("__group.__part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        "__group",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__shift"),
        F.sum("__rows").over(group).alias("__n"),
        *[F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__cs_{k}") for k in sums],
        *[F.last(f"__l_{k}", True).over(earlier).alias(f"__cl_{k}") for k in lasts],
        F.lag("__b").over(by_part).alias("__cb"),
        F.lead("__a").over(by_part).alias("__ca"),
    )
    inside = Window.partitionBy("__group").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = parts.select(
        *df.columns,
        "__group",
        F.row_number().over(inside).alias("__at"),
        *[F.sum(f"__s_{k}").over(upto).alias(f"__s_{k}") for k in sums],
        *[F.last(f"__l_{k}", True).over(upto).alias(f"__l_{k}") for k in lasts],
        F.lag("__b").over(inside).alias("__b"),
        F.lead("__a").over(inside).alias("__a"),
    )
    return own.join(carried, "__group").select(
        *df.columns,
        (F.col("__shift") + F.col("__at")).alias("__i"),
        "__n",
        *[(F.col(f"__cs_{k}") + F.col(f"__s_{k}")).alias(k) for k in sums],
        *[F.coalesce(f"__l_{k}", f"__cl_{k}").alias(k) for k in lasts],
        *[F.coalesce("__b", "__cb").getField(k).alias(k) for k in before],
        *[F.coalesce("__a", "__ca").getField(k).alias(k) for k in after],
    )


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, size): how many rows of a group have each value, how many a smaller one, and how many there are; nulls are left out.

    Values are counted first and dealt out by range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("__group", F.struct(*keys, F.spark_partition_id().alias("__part"))))
    over, before = Window.partitionBy(*[F.col("__group").getField(k) for k in keys]), (Window.unboundedPreceding, -1)
    held = parts.groupBy("__group").agg(F.sum("n").alias("held"))
    shifted = held.select("__group", F.coalesce(F.sum("held").over(over.orderBy("__group.__part").rowsBetween(*before)), F.lit(0)).alias("shift"), F.sum("held").over(over).alias("size"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("__group").orderBy(value).rowsBetween(*before)), F.lit(0))
    return parts.withColumn("within", within).join(shifted, "__group").select(*keys, value, "n", (F.col("shift") + F.col("within")).alias("before"), "size")


def value_at(value: str, place: Column) -> Column:
    """Aggregate over ``value_ranks``: the value at a place (from 1) of a group."""
    return F.max(F.when((F.col("before") < place) & (place <= F.col("before") + F.col("n")), F.col(value)))


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the exact median of each group's known values; a group without any has no row."""
    size = F.col("size")
    middle = (value_at(value, F.floor((size + 1) / 2)) + value_at(value, F.floor(size / 2) + 1)) / 2
    return value_ranks(df, keys, value).groupBy(*keys).agg(middle.alias(name))
