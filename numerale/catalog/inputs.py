"""Inputs of the catalogued queries, all derived from the tables by Spark.

Sequence-model answers are not available offline.  Their place is taken by
*analogs* (the same season of earlier years, as sampled texts) and by
log-probabilities that follow a fixed rule of the token position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from numerale.functions import token_array
from numerale.operators.calendar import split_holdout, weekly_series
from numerale.operators.scaling import attach_scaler
from numerale.operators.textnum import encode, joined_chunks
from numerale.plans.prepare import marked_chunks
from numerale.settings import CONTEXT_TOKENS, TextFormat
from numerale.sources import lineitem_by_supplier, orders_by_nation, orders_by_priority

HORIZON = 30
SEASON = 52
ANALOGS = 5
DECIMALS = 2  # every bound value column has at most two decimals
FMT = TextFormat()
FMT2 = TextFormat(prec=2)
GREEDY = TextFormat(digit_mode="greedy")


def s1(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_series(orders_by_priority(spark, sf), DECIMALS)


def s2(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_series(orders_by_nation(spark, sf), DECIMALS)


def s3(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_series(lineitem_by_supplier(spark, sf), DECIMALS)


def fitted(series: DataFrame, kind: str = "basic", alpha: float = 0.95, beta: float = 0.3) -> DataFrame:
    """The series with its last steps held out and a scaler fitted on the rest."""
    marked = split_holdout(series, HORIZON)
    return attach_scaler(marked, kind, alpha, beta, fit_on=F.col("split") == "train")


def scalers_of(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.max("offset").alias("offset"), F.max("scale").alias("scale"))


def truth_of(series: DataFrame) -> DataFrame:
    """The held-out steps, numbered from 0."""
    held = F.col("n") - HORIZON
    return series.where(F.col("i") >= held).select("series_id", (F.col("i") - held).alias("step"), "y")


def analog_completions(series: DataFrame, fmt: TextFormat = FMT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sample s: the weeks of the horizon s + 1 years earlier, s steps shorter than the first.

    ``carry`` names columns that are constant within a series.
    """
    sample = F.explode(F.sequence(F.lit(0), F.lit(ANALOGS - 1)))
    rows = encode(fitted(series), fmt).withColumn("sample_id", sample)
    step = F.col("i") - (F.col("n") - HORIZON - SEASON * (F.col("sample_id") + 1))
    rows = rows.where((step >= 0) & (step <= HORIZON - F.col("sample_id")))
    return rows.groupBy("series_id", "sample_id").agg(joined_chunks(fmt).alias("text"), *[F.max(c).alias(c) for c in carry])


def season_completions(series: DataFrame, fmt: TextFormat = FMT) -> DataFrame:
    """Every week of every series as a text to be read: sample s holds the steps of season s."""
    rows = encode(fitted(series), fmt).withColumn("sample_id", F.floor(F.col("i") / SEASON).cast("int"))
    return rows.groupBy("series_id", "sample_id").agg(joined_chunks(fmt).alias("text"))


def rule_responses(series: DataFrame, fmt: TextFormat = FMT2, context: int = CONTEXT_TOKENS) -> DataFrame:
    """Prompt plus held-out steps as one scored text per series, with the training and validation lengths."""
    train = F.col("split") == "train"
    rows = fitted(series, "advanced", 0.5, 0.15).withColumn("n_val", F.least(F.col("n"), F.lit(HORIZON)))
    marked = marked_chunks(rows, fmt, True, HORIZON, context, within=train)
    kept = marked.where((F.col("i") >= F.col("cut")) | ~train)
    tokens = F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("i", token_array("chunk", fmt).alias("t")))), lambda s: s["t"])
    )
    texts = kept.groupBy("series_id").agg(
        tokens.alias("tokens"),
        F.count_if(train).alias("n_train"),
        F.max("n_val").alias("n_val"),
        F.max("scale").alias("scale"),
    )

    return texts.withColumns(_by_rule())


def _by_rule() -> dict[str, Column]:
    """Log-probabilities and alternatives that follow from the position of a token in ``tokens``."""

    def logprob(k):
        return -(F.lit(0.1) + (k * 7 % 23) / 10.0)

    def top(t, k):
        word = F.create_map(t, logprob(k))
        odd = F.create_map(F.lit(" the"), -(F.lit(2.0) + k % 5))
        return F.when(k % 3 == 0, F.map_concat(word, odd)).otherwise(word)

    return {
        "token_logprobs": F.transform("tokens", lambda t, k: F.when(k > 0, logprob(k).cast("float"))),
        "top_logprobs": F.transform("tokens", top),
    }


def rule_answers(requests: DataFrame, fmt: TextFormat = FMT) -> DataFrame:
    """Answers by the same rule to scoring requests, as a model would land them: one row with parallel arrays each.

    The last point of every grid has no answer.
    """
    last = F.max("pid").over(Window.partitionBy("series_id"))
    asked = requests.withColumn("_last", last).where((F.col("status") == "ok") & (F.col("pid") < F.col("_last")))
    pieces = F.filter(F.split("prompt", f"\\Q{fmt.time_sep}\\E", -1), lambda p: F.length(p) > 0)
    tokens = F.flatten(F.transform(pieces, lambda p: token_array(p, fmt)))
    return asked.select("series_id", "pid", tokens.alias("tokens")).withColumns(_by_rule())
