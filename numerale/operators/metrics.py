"""Samples to point forecasts, and forecasts against the truth.

Joins on the step never hide missing steps: every metric carries the number
of steps it could not match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerale.functions import key_columns, require_columns
from numerale.operators.scaling import _with_scaler, unscaled


def common_horizon(decoded: DataFrame) -> DataFrame:
    """Steps that every sample of a series has; a sample without any step makes it 0."""
    require_columns(decoded, "usable")
    return decoded.groupBy(*key_columns(decoded)).agg(
        F.min("usable").alias("horizon"), F.count(F.lit(1)).alias("n_samples")
    )


def clip_samples(decoded: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Long samples ``(…, sample_id, step, z)`` cut to the common horizon.

    The horizon comes from a window over the not yet exploded samples; the
    grouping by step that follows reuses the same layout.  With ``keep_empty`` the samples of a
    series whose horizon is 0 keep a row without step and value.
    """
    require_columns(decoded, "zs", "usable")
    carried = [c for c in decoded.columns if c not in ("zs", "usable")]
    shortest = F.min("usable").over(Window.partitionBy(*key_columns(decoded)))
    rows = decoded.withColumn("_h", shortest)
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return rows.select(*carried, explode(F.slice("zs", F.lit(1), F.col("_h"))).alias("step", "z"))


def rescale(samples: DataFrame, scalers: DataFrame) -> DataFrame:
    """Samples back on the original scale, as ``x``."""
    return _with_scaler(samples, scalers).withColumn("x", unscaled("z")).drop("z", "offset", "scale")


def mae(samples: DataFrame, truth: DataFrame, col: str = "x") -> DataFrame:
    """Mean absolute error over all samples and steps, against ``truth(series_id, step, y)``."""
    require_columns(samples, "step", col)
    on = [*key_columns(truth), "step"]
    joined = samples.join(truth.select(*on, "y"), on, "left")
    return joined.groupBy(*key_columns(samples)).agg(
        F.avg(F.abs(F.col(col) - F.col("y"))).alias("mae"),
        F.count(F.col(col) - F.col("y")).alias("compared"),
        F.count_if(F.col("y").isNull()).alias("unmatched"),
    )


def point_forecast(samples: DataFrame, col: str = "x") -> DataFrame:
    """Median over the samples of every step."""
    return samples.groupBy(*key_columns(samples), "step").agg(F.median(col).alias("yhat"))


def attach_model(predictions: DataFrame, forecast: DataFrame, name: str) -> DataFrame:
    """Add a forecast to ``predictions(series_id, step, model, yhat)`` as one more model.

    The benchmark is cut to the steps the forecast has, series by series.  A
    series without any forecast keeps its whole benchmark and gets a row without
    a value for each of its steps, so that no comparison loses it.

    Both sides are put together and laid out by series once; no side is planned twice.
    """
    keys = key_columns(forecast)
    added = forecast.where("step is not null").select(*keys, "step", F.lit(name).alias("model"), "yhat", F.lit(True).alias("_new"))
    both = predictions.select(*keys, "step", "model", "yhat", F.lit(False).alias("_new")).unionByName(added)
    length = F.max(F.when(F.col("_new"), F.col("step") + 1)).over(Window.partitionBy(*keys))
    first = F.col("model") == F.min("model").over(Window.partitionBy(*keys, "step"))
    rows = both.withColumns({"_h": length, "_first": first}).where(F.col("_new") | F.col("_h").isNull() | (F.col("step") < F.col("_h")))
    own = F.struct("model", "yhat")
    nothing = F.when(F.col("_h").isNull() & F.col("_first"), F.struct(F.lit(name).alias("model"), F.lit(None).cast("double").alias("yhat")))
    return rows.select(*keys, "step", F.inline(F.array_compact(F.array(own, nothing))))


def unpivot_models(wide: DataFrame, models: Sequence[str] | None = None, truth: str = "test") -> DataFrame:
    """A wide benchmark to long form, the truth column left out."""
    ids = [*key_columns(wide), "step"] if "series_id" in wide.columns else ["step"]
    names = [c for c in (models or wide.columns) if c not in (*ids, truth)]
    return wide.unpivot(ids, [F.col(c).cast("double").alias(c) for c in names], "model", "yhat")


def wide_report(predictions: DataFrame, truth: DataFrame, max_models: int = 1000) -> DataFrame:
    """One row per series and step: the truth and a column for every model found in ``predictions``.

    Steps of either side stay.  The model names are looked up first, so that one aggregation makes all columns;
    more than ``max_models`` names are an error, as is a model called like one of the other columns.
    """
    keys = [*key_columns(truth), "step"]
    names = [r.model for r in predictions.select("model").where("model is not null").distinct().limit(max_models + 1).collect()]
    taken = [n for n in names if n in (*keys, "y")]
    if len(names) > max_models or taken:
        raise ValueError(f"more than {max_models} models" if not taken else f"models cannot be called {taken}")
    rows = predictions.where("model is not null").select(*keys, "model", "yhat")
    rows = rows.unionByName(truth.select(*keys, F.lit(None).cast("string").alias("model"), F.col("y").alias("yhat")))
    cells = [F.max(F.when(F.col("model") == n, F.col("yhat"))).alias(n) for n in sorted(names)]
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("model").isNull(), F.col("yhat"))).alias("y"), *cells)


def compare_models(predictions: DataFrame, truth: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Error of every model against the truth, with the steps that had no counterpart.

    ``series_without_forecast`` counts series for which a model has no value at all.
    """
    on = [c for c in ("series_id", "pid", "step") if c in truth.columns and c in predictions.columns]
    joined = predictions.join(truth.select(*on, "y"), on, "left")
    error: Column = F.abs(F.col("yhat") - F.col("y"))
    sums = [F.sum(error).alias("_e"), F.count(error).alias("_n"), F.count_if(error.isNull()).alias("_u"), F.count("yhat").alias("_f")]
    series = [k for k in ("series_id",) if k in predictions.columns and k not in by]
    each = joined.groupBy(*by, *series).agg(*sums)
    return each.groupBy(*by).agg(
        F.try_divide(F.sum("_e"), F.sum("_n")).alias("mae"),
        F.sum("_n").alias("compared"),
        F.sum("_u").alias("unmatched"),
        F.count_if(F.col("_f") == 0).alias("series_without_forecast"),
    )
