"""Assumptions of the method as data checks: they return counts, never stop a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.functions import key_columns


def check_positive(series: DataFrame) -> DataFrame:
    """Steps that are not positive, per series."""
    return series.groupBy(*key_columns(series)).agg(
        F.count_if(F.col("y") <= 0).alias("violations"), F.count("y").alias("checked")
    )


def check_unit_quantile(scaled_rows: DataFrame, alpha: float, tol: float = 1e-9) -> DataFrame:
    """The alpha-quantile of positive data under the basic scaler is 1."""
    quantile = F.percentile("z", F.lit(alpha))
    return (
        scaled_rows.groupBy(*key_columns(scaled_rows))
        .agg(quantile.alias("quantile"))
        .withColumn("ok", F.abs(F.col("quantile") - 1.0) <= tol)
    )


def check_unique_step(series: DataFrame) -> DataFrame:
    """Steps that occur more than once in a series."""
    return (
        series.groupBy(*key_columns(series), "i").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    )


def check_truth(benchmark: DataFrame, truth: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Where the benchmark's truth ``(series_id, step, test)`` differs from ours ``(series_id, step, y)``.

    Steps present on one side only are reported too.
    """
    on = ["series_id", "step"]
    both = benchmark.select(*on, "test", F.lit(True).alias("_b")).join(
        truth.select(*on, "y", F.lit(True).alias("_t")), on, "full_outer"
    )
    problem = (
        F.when(F.col("_b").isNull(), "not_in_benchmark")
        .when(F.col("_t").isNull(), "not_in_truth")
        .when(F.col("test").isNull() & F.col("y").isNull(), None)
        .when(F.col("test").isNull() | F.col("y").isNull(), "missing_value")
        .when(F.abs(F.col("test") - F.col("y")) > tol, "differs")
    )
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_b", "_t")
