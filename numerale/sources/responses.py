"""What a sequence model sends back: sampled texts and token log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numerale.functions import key_columns

COMPLETIONS = "series_id STRING, pid INT, sample_id INT, text STRING"

#: One row per scored text; the three arrays run in parallel and the first log-probability is NULL.
LOGPROBS = (
    "series_id STRING, pid INT, tokens ARRAY<STRING>, token_logprobs ARRAY<FLOAT>, "
    "top_logprobs ARRAY<MAP<STRING, DOUBLE>>"
)


def read_completions(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType = COMPLETIONS, fmt: str = "parquet"
) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_token_logprobs(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType = LOGPROBS, fmt: str = "json"
) -> DataFrame:
    """Scored texts as they were landed, one row each; see ``explode_logprobs`` for the long form."""
    return spark.read.schema(schema).format(fmt).load(path)


def explode_logprobs(responses: DataFrame) -> DataFrame:
    """Long form ``(…, pos, tok, logprob, top)``, one row per token."""
    carried = [c for c in responses.columns if c not in ("tokens", "token_logprobs", "top_logprobs")]
    zipped = F.arrays_zip("tokens", "token_logprobs", "top_logprobs")
    return responses.select(*carried, F.posexplode(zipped).alias("pos", "t")).select(
        *carried,
        "pos",
        F.col("t.tokens").alias("tok"),
        F.col("t.token_logprobs").alias("logprob"),
        F.col("t.top_logprobs").alias("top"),
    )


def gather_logprobs(long: DataFrame) -> DataFrame:
    """The inverse of ``explode_logprobs``: one row with parallel arrays per series (and grid point)."""
    keys = key_columns(long)
    # maps cannot be compared, so they travel as entries through the sort
    steps = F.array_sort(F.collect_list(F.struct("pos", "tok", "logprob", F.map_entries("top").alias("top"))))
    return long.groupBy(*keys).agg(steps.alias("t")).select(
        *keys,
        F.transform("t", lambda x: x["tok"]).alias("tokens"),
        F.transform("t", lambda x: x["logprob"]).alias("token_logprobs"),
        F.transform("t", lambda x: F.map_from_entries(x["top"])).alias("top_logprobs"),
    )
