"""Compile-time models: a weighted ridge regression for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Newest samples of a key, and the ridge.
SAMPLES, RIDGE = 100, 0.01


def solved(matrix: Column, size: int) -> Column:
    """The last column of an augmented matrix (rows as arrays) once the rest is made the unit matrix; for matrices with positive pivots, as those with a ridge."""

    def eliminate(m: Column, c: Column) -> Column:
        pivot = F.get(m, c)
        head = F.get(pivot, c)
        return F.transform(m, lambda row, i: F.when(i == c, F.transform(row, lambda x: x / head)).otherwise(F.transform(row, lambda x, j: x - F.get(row, c) * F.get(pivot, j) / head)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def fit_compile_model(samples: DataFrame, key: str, features: list[str], target: str, order: list, *, newest: int = SAMPLES, ridge: float = RIDGE) -> DataFrame:
    """(key, coefficients, bias, n) from each key's newest samples; keys with fewer than three whole ones have no model.

    Weights fall from 1 by a hundredth a sample with age.  The solution has no intercept; the bias is the weighted mean residual.
    All comes from one aggregation of weighted products; the system of a key is solved in its row.
    """
    columns = [F.col(c).cast("double") for c in (*features, target)]
    recent = samples.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("age") <= newest)
    k = len(features)
    held = recent.select(key, (1 - 0.01 * (F.col("age") - 1)).alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"x{i}" for i in range(k + 1)])
    sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k + 1)]
    means = [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"m{i}") for i in range(k + 1)]
    moments = held.groupBy(key).agg(F.count("*").alias("n"), F.sum("w").alias("w"), *sums, *means).filter("n >= 3")
    cell = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    matrix = F.array(*[F.array(*[cell(i, j) for j in range(k + 1)]) for i in range(k)])
    fitted = moments.withColumn("coefficients", solved(matrix, k))
    explained = sum((F.get("coefficients", F.lit(i)) * F.col(f"m{i}") for i in range(k)), F.lit(0.0))
    return fitted.select(key, "coefficients", ((F.col(f"m{k}") - explained) / F.col("w")).alias("bias"), "n")


def predict_compile_time(coefficients: Column, bias: Column, features: Column) -> Column:
    """At least a tenth of a second."""
    dot = F.aggregate(F.zip_with(coefficients, features, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(dot + bias, F.lit(0.1))
