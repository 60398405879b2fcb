"""From observations to regular weekly series.

Two shuffles in all: observations are pre-aggregated per task and meet on
``(series_id, wk)``, so a series that holds a third of all observations is
spread over its weeks; then weeks move once to ``series_id``.  Everything
downstream (scaler, text, budget, next-token counts) groups by ``series_id``
first and reuses that second layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerale.functions import by_key, key_columns, require_columns, week_end
from numerale.operators.exact import exact_mean


def select_target(df: DataFrame, col: str, keys: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Keep keys and one value column; the scan then reads only these."""
    return require_columns(df, *keys, col).select(*keys, F.col(col).alias("value"))


def _mean(col: str, decimals: int) -> Column:
    # sums of whole units do not depend on the order of addition, so digits cut from the mean are
    # stable; a sum beyond the range of BIGINT is an error under ANSI, never a wrong number
    unit = float(10**decimals)
    total = F.sum(F.rint(F.col(col) * unit).cast("bigint")).cast("double") / unit
    return total / F.nullif(F.count(col), F.lit(0))


def resample_mean(
    observations: DataFrame, value_cols: Sequence[str] = ("value",), decimals: int | None = None
) -> DataFrame:
    """Mean per series and week, missing values skipped: ``(series_id, wk, y)``.

    The mean has the same bits however the rows lie: without ``decimals`` the values are added
    digit by digit (``exact_mean``).  ``decimals`` states that the values have at most so many
    decimals, so that whole units can be added, which is cheaper; ``off_scale`` counts the values
    that this rounds.  With several value columns each keeps its name.
    """
    require_columns(observations, "series_id", "ts", *value_cols)
    names = ["y"] if len(value_cols) == 1 else list(value_cols)
    if decimals is None:
        means = exact_mean(observations, ["series_id", week_end("ts").alias("wk")], list(value_cols))
        return means.select("series_id", "wk", *[F.col(c).alias(n) for c, n in zip(value_cols, names)])
    means = [_mean(c, decimals).alias(n) for c, n in zip(value_cols, names)]
    return observations.groupBy("series_id", week_end("ts").alias("wk")).agg(*means)


def off_scale(observations: DataFrame, decimals: int, col: str = "value") -> DataFrame:
    """Per series, the values and how many of them have more than ``decimals`` decimals, with the largest difference made."""
    unit = float(10**decimals)
    gap = F.abs(F.rint(F.col(col) * unit) / unit - F.col(col))
    return observations.groupBy("series_id").agg(
        F.count(col).alias("observations"), F.count_if(gap > 0).alias("off_scale"), F.max(gap).alias("largest")
    )


def calendar_spine(weekly: DataFrame) -> DataFrame:
    """Add the empty weeks inside each series' range, the step ``i`` and the length ``n``.

    Each week fills the gap up to its successor, so no calendar table and no
    join is needed, and the step is plain date arithmetic.
    """
    require_columns(weekly, "series_id", "wk")
    values = [c for c in weekly.columns if c not in ("series_id", "wk")]
    series = Window.partitionBy("series_id")
    ordered = series.orderBy("wk")
    upto_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def weeks(later: Column, earlier: Column) -> Column:
        return (F.datediff(later, earlier) / 7).cast("int")

    # "gap" counts this week and the empty ones after it
    known = weekly.withColumns(
        {
            "gap": F.coalesce(weeks(F.lead("wk").over(ordered), F.col("wk")), F.lit(1)),
            "start": F.min("wk").over(upto_here),
            "stop": F.max("wk").over(series),
        }
    )
    filled = known.select("*", F.explode(F.sequence(F.lit(0), F.col("gap") - 1)).alias("k"))
    return filled.select(
        "series_id",
        F.date_add("wk", F.col("k") * 7).alias("wk"),
        (weeks(F.col("wk"), F.col("start")) + F.col("k")).alias("i"),
        (weeks(F.col("stop"), F.col("start")) + 1).alias("n"),
        *[F.when(F.col("k") == 0, F.col(v)).alias(v) for v in values],
    )


def weekly_series(observations: DataFrame, decimals: int | None = None) -> DataFrame:
    """Observations to ``series(series_id, wk, i, n, y)``; y is NULL in an empty week."""
    return calendar_spine(resample_mean(observations, decimals=decimals))


def with_step(df: DataFrame, order_by: str = "wk") -> DataFrame:
    """Number the rows of each series from 0 in the given order."""
    return df.withColumn("i", F.row_number().over(by_key(df).orderBy(order_by)) - 1)


def head_per_series(series: DataFrame, n: int) -> DataFrame:
    """The first n steps of every series, by step number: a filter, no sort."""
    return require_columns(series, "i").where(F.col("i") < n)


def series_profile(series: DataFrame) -> DataFrame:
    """Steps, gaps and range of every series."""
    return series.groupBy(*key_columns(series)).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("y").isNull()).alias("gaps"),
        F.min("wk").alias("first_wk"),
        F.max("wk").alias("last_wk"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def split_holdout(series: DataFrame, k: int, col: str = "split", held: str = "val", rest: str = "train") -> DataFrame:
    """Mark the last k steps of every series; a series of k steps or fewer has no ``rest`` part."""
    require_columns(series, "i", "n")
    return series.withColumn(col, F.when(F.col("i") >= F.col("n") - k, held).otherwise(rest))


def concat_splits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append the steps of ``second`` after those of ``first``, series by series.

    ``second`` keeps its order and is renumbered to start where ``first``
    ends, whether its own steps start at 0 or not.
    """
    require_columns(first, "i", "y")
    require_columns(second, "i", "y")
    keys = key_columns(first)
    both = first.select(*keys, "i", "y", F.lit(0).alias("part")).unionByName(
        second.select(*keys, "i", "y", F.lit(1).alias("part"))
    )
    order = Window.partitionBy(*keys).orderBy("part", "i")
    return both.withColumn("i", F.row_number().over(order) - 1).drop("part")
