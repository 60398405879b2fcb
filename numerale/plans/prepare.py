"""From a series to the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.functions import bound_once, require_columns
from numerale.operators.budget import count_tokens, mark_budget, packed_cut, prompts, step_tokens
from numerale.operators.textnum import chunk_of, encode, prec_of
from numerale.settings import CONTEXT_TOKENS, STEP_MULTIPLIER, TextFormat

# Fixed value: steps to predict that a prompt leaves room for unless told otherwise.
PREPARE_STEPS = 10


def marked_chunks(
    series: DataFrame,
    fmt: TextFormat,
    truncate: bool = True,
    n_steps: int = PREPARE_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    within: Column | None = None,
    n_tok: Column | None = None,
) -> DataFrame:
    """Steps with offset and scale to chunks with token counts (see ``count_tokens``) and the cut."""
    rows = count_tokens(encode(series, fmt), fmt, n_tok)
    if truncate:
        return mark_budget(rows, n_steps, context, multiplier, within)
    return rows.withColumn("cut", F.lit(0))


def pack_marked_chunks(
    packed: DataFrame,
    fmt: TextFormat,
    n_steps: int = PREPARE_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    within: str | None = None,
) -> DataFrame:
    """``marked_chunks`` of rows that hold their steps as an array (``pack_grid_scalers``): ``steps`` (i, fit, chunk, n_tok) and ``cut``.

    ``within`` names the field that says which steps the budget counts.
    """
    prec = prec_of(packed)
    step = packed.schema["steps"].dataType.elementType["i"].dataType

    def written(s: Column) -> Column:
        def counted(chunk: Column) -> Column:
            n_tok = step_tokens(chunk, fmt).cast("int")
            return F.struct(s["i"].alias("i"), s["fit"].alias("fit"), chunk.alias("chunk"), n_tok.alias("n_tok"))

        return bound_once(chunk_of(s["y"], fmt, prec), counted)

    rows = packed.withColumn("steps", F.transform("steps", written))
    return rows.withColumn("cut", packed_cut(step, n_steps, context, multiplier, within))


def prepare(
    series: DataFrame,
    fmt: TextFormat,
    truncate: bool = True,
    n_steps: int = PREPARE_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    n_tok: Column | None = None,
) -> DataFrame:
    """One prompt per series with its token report.

    ``series`` carries offset and scale (``attach_scaler``, or a join with a
    scaler table).  Without truncation the whole series is kept.
    """
    require_columns(series, "y", "offset", "scale", "i")
    return prompts(marked_chunks(series, fmt, truncate, n_steps, context, multiplier, n_tok=n_tok), fmt)
