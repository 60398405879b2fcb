"""Scale, write, read back, unscale: the whole text path without a model in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.operators.scaling import attach_scaler, unscaled
from numerale.operators.textnum import decode_steps, encode, joined_chunks, split_completion
from numerale.settings import TextFormat


def round_trip(series: DataFrame, fmt: TextFormat, kind: str = "basic", alpha: float = 0.95) -> DataFrame:
    """Error that writing a series as text adds, per series.

    The text is read the way a completion is: its last step is dropped, a
    missing step is malformed and not compared.
    """
    rows = encode(attach_scaler(series, kind, alpha), fmt)
    texts = rows.groupBy("series_id").agg(
        joined_chunks(fmt).alias("text"),
        F.max("offset").alias("offset"),
        F.max("scale").alias("scale"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("ys"),
    )
    steps = decode_steps(split_completion(texts, fmt), fmt).withColumn("x", unscaled("z"))
    error = F.abs(F.col("x") - F.get("ys", F.col("step")))
    return steps.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count(error).alias("compared"),
        F.avg(error).alias("mae"),
        F.max(error).alias("max_error"),
        F.max("scale").alias("scale"),
    )
