"""Negative log-likelihood per step (NLL/D) of a continuation, from token log-probabilities.

A scored text arrives as one row with parallel arrays and is bounded by the
model's context, so every step here is a projection over that row: no token
is exploded, shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.functions import key_columns, require_columns
from numerale.functions.columns import column
from numerale.operators.textnum import prec_of
from numerale.settings import TextFormat


def validation_start(responses: DataFrame, n_train: Column | str | int, fmt: TextFormat) -> DataFrame:
    """Add ``val_start``: the token after the n_train-th separator; NULL when there are fewer."""
    require_columns(responses, "tokens")
    at = F.transform("tokens", lambda t, k: F.when(t == fmt.time_sep, k))
    separators = F.filter(at, lambda k: k.isNotNull())
    wanted = column(n_train).cast("int")
    start = F.when(wanted > 0, F.get(separators, wanted - 1) + 1)
    return responses.withColumn("val_start", start)


def extra_mass(top: Column, fmt: TextFormat) -> Column:
    """Probability of disallowed tokens among the reported alternatives of one token."""
    if not fmt.bit_sep:
        return F.lit(0.0)
    allowed = F.array(*map(F.lit, fmt.allowed_tokens(scoring=True)))
    odd = F.map_values(F.map_filter(top, lambda tok, _: ~F.array_contains(allowed, tok)))
    return F.coalesce(F.aggregate(odd, F.lit(0.0), lambda acc, lp: acc + F.exp(lp)), F.lit(0.0))


def validation_tokens(responses: DataFrame) -> DataFrame:
    """Only the tokens from ``val_start`` on, all three arrays cut alike; none without a start."""
    require_columns(responses, "val_start")

    def cut(name: str) -> Column:
        return F.slice(name, F.coalesce(F.col("val_start"), F.size(name)) + 1, F.size(name))

    return responses.withColumns({c: cut(c) for c in ("tokens", "token_logprobs", "top_logprobs")})


def adjusted_logprobs(responses: DataFrame, fmt: TextFormat) -> DataFrame:
    """Add ``adjusted``: log-probabilities renormalised to the allowed tokens.

    NULL where the disallowed tokens hold all of the mass.
    """

    def renormalised(logprob: Column, top: Column) -> Column:
        rest = 1.0 - extra_mass(top, fmt)
        return F.when(rest > 0, logprob.cast("double") - F.ln(rest))

    return responses.withColumn("adjusted", F.zip_with("token_logprobs", "top_logprobs", renormalised))


def nll_per_step(responses: DataFrame, n_train: Column | str | int, n_val: Column | str | int, fmt: TextFormat) -> DataFrame:
    """Add ``nll`` per validation step and ``status``.

    NULL with a status instead of a number when the start is not found, a
    log-probability is absent or the mass of allowed tokens is 0.
    """
    rows = adjusted_logprobs(validation_tokens(validation_start(responses, n_train, fmt)), fmt)
    # adding a NULL gives NULL, so one unusable token makes the sum NULL
    total = F.aggregate("adjusted", F.lit(0.0), lambda acc, lp: acc + lp)
    status = (
        F.when(F.col("val_start").isNull(), "no_validation_start")
        .when(F.size("adjusted") == 0, "no_validation_tokens")
        .when(F.exists("adjusted", lambda lp: lp.isNull()), "unusable_token")
        .otherwise("ok")
    )
    return (
        rows.withColumn("status", status)
        .withColumn("nll", F.when(F.col("status") == "ok", F.try_divide(-total, column(n_val).cast("double"))))
        .drop("tokens", "token_logprobs", "top_logprobs", "adjusted")
    )


def bin_correction(fmt: TextFormat, prec: Column | None = None) -> Column:
    """Log-density of the bins: a digit text stands for an interval of base^-prec."""
    return (F.lit(fmt.prec) if prec is None else prec) * F.ln(F.lit(float(fmt.base)))


def nlld(scored: DataFrame, fmt: TextFormat) -> DataFrame:
    """Add ``nlld`` to rows with ``nll`` and ``scale``: bins and scaling taken back.

    The scaler is affine, so the mean log-derivative taken away is -ln(scale).
    """
    require_columns(scored, "nll", "scale")
    back = F.when(F.col("scale") > 0, F.ln("scale"))
    return scored.withColumn("nlld", F.col("nll") - bin_correction(fmt, prec_of(scored)) + back)


def score(
    responses: DataFrame,
    scalers: DataFrame,
    n_train: Column | str | int,
    n_val: Column | str | int,
    fmt: TextFormat,
) -> DataFrame:
    """NLL/D of landed responses: locate, renormalise, average, correct for bins and scale."""
    per_step = nll_per_step(responses, n_train, n_val, fmt)
    on = [c for c in key_columns(scalers) if c in per_step.columns]
    return nlld(per_step.join(scalers.select(*on, "scale"), on, "left"), fmt)
