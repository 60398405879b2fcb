"""Forecast with given or tuned parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.functions import bound_once, require_columns
from numerale.operators.metrics import clip_samples
from numerale.operators.nexttoken import build_requests, draw_completions, step_codes, text_tables
from numerale.operators.budget import packed_prompts
from numerale.operators.scaling import pack_grid_scalers, unscaled
from numerale.operators.textnum import decode_completions
from numerale.plans.prepare import pack_marked_chunks
from numerale.plans.tuning import for_grid
from numerale.settings import CONTEXT_TOKENS, STEP_MULTIPLIER, TextFormat

# Parameters, horizon and samples of the final forecast.
FINAL = {"pid": 0, "alpha": 0.2, "beta": 0.15, "prec": 2, "temp": 1.0}
FORECAST_STEPS = 30
FORECAST_SAMPLES = 10


def request_rows(
    series: DataFrame,
    fmt: TextFormat,
    grid: Sequence[dict] = (FINAL,),
    best: DataFrame | None = None,
    fit_on: Column | None = None,
    n_steps: int = FORECAST_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
) -> DataFrame:
    """One row per series: the chunks of the whole series (``steps``) under its own parameters, and the cut.

    The scaler sees only ``fit_on`` (the training part), the prompt all of
    ``series``.  With ``best(series_id, pid)`` every series uses its own grid
    point; without it ``grid`` must hold one point, used for all.
    """
    require_columns(series, "series_id", "i", "y")
    if best is None and len(grid) != 1:
        raise ValueError("a grid of several points needs the best point per series")
    rows = pack_grid_scalers(series, grid, fit_on, best)
    # one grid point per series from here on: series_id alone is the key
    return pack_marked_chunks(rows.drop("pid"), for_grid(fmt, grid), n_steps, context, multiplier)


def _samples(
    series: DataFrame,
    fmt: TextFormat = TextFormat(),
    grid: Sequence[dict] = (FINAL,),
    best: DataFrame | None = None,
    fit_on: Column | None = None,
    n_steps: int = FORECAST_STEPS,
    n_samples: int = FORECAST_SAMPLES,
    completions: DataFrame | None = None,
) -> DataFrame:
    """``forecast_samples`` with the status, and a row without a step for each sample of a series that has no forecast."""
    marked = request_rows(series, fmt, grid, best, fit_on, n_steps)
    parameters = ("offset", "scale", "prec")
    prepared = packed_prompts(marked, fmt, (*parameters, "temp"))
    status = F.when(F.col("prec").isNull(), "no_usable_score").when(F.col("scale").isNull(), "no_training_part")
    prepared = prepared.withColumn("status", status.otherwise(F.col("status")))
    if completions is None:
        kept = bound_once(F.col("cut"), lambda cut: F.filter("steps", lambda s: s["i"] >= cut))
        model = text_tables(marked.select("series_id", step_codes(kept, fmt).alias("codes")), fmt)
        requests = build_requests(prepared, fmt, n_steps, F.col("temp"), n_samples, carry=parameters)
        answers = draw_completions(model, requests, fmt, (*parameters, "status"))
    else:
        answers = prepared.select("series_id", *parameters, "status").join(completions, "series_id", "left")
        missing = F.col("text").isNull() & (F.col("status") == "ok")
        answers = answers.withColumns(
            {"status": F.when(missing, "no_answer").otherwise(F.col("status")), "text": F.coalesce("text", F.lit(""))}
        )
    rows = clip_samples(decode_completions(answers, fmt), keep_empty=True)
    reached = F.when(F.col("step").isNotNull() & F.col("scale").isNotNull(), "ok")
    status = reached.when(F.col("status") != "ok", F.col("status")).otherwise("no_common_step")
    return rows.select("series_id", "sample_id", "step", unscaled("z").alias("x"), status.alias("status"))


def forecast_samples(series: DataFrame, fmt: TextFormat = TextFormat(), **options) -> DataFrame:
    """Samples ``(series_id, sample_id, step, x)`` on the original scale, cut to the common horizon.

    ``completions`` are the landed answers of a model to the requests; when
    absent, the offline next-token model draws them.
    """
    return _samples(series, fmt, **options).where("status = 'ok'").drop("status")


def forecast(series: DataFrame, fmt: TextFormat = TextFormat(), **options) -> DataFrame:
    """Median of the samples per step, as far as the shortest sample reaches: ``(series_id, step, yhat, status)``.

    Every series is in the result: one that cannot be forecast has a single row without step and value,
    whose status says why (``no_usable_score``, ``no_training_part``, ``does_not_fit``, ``no_model``, ``no_answer``, ``no_common_step``).
    """
    samples = _samples(series, fmt, **options)
    step = F.when(F.col("status") == "ok", F.col("step")).alias("step")
    return samples.select("series_id", step, "x", "status").groupBy("series_id", "step").agg(
        F.median("x").alias("yhat"), F.max("status").alias("status")
    )
