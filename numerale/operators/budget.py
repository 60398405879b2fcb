"""Tokens of a text and the cut that makes it fit a model's context.

The budget is a suffix sum over one series, so finding the cut costs one
sort instead of re-tokenising every suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numerale.functions import bound_once, by_key, key_columns, newest_first, require_columns, token_array, token_count
from numerale.functions.columns import column
from numerale.operators.textnum import joined_chunks, kept_text
from numerale.settings import CONTEXT_TOKENS, STEP_MULTIPLIER, TextFormat


def tokens(chunk_rows: DataFrame, fmt: TextFormat) -> DataFrame:
    """One row per token: position ``j`` within step ``i``."""
    carried = [c for c in chunk_rows.columns if c != "chunk"]
    return chunk_rows.select(*carried, F.posexplode(token_array("chunk", fmt)).alias("j", "tok"))


def step_tokens(chunk: Column | str, fmt: TextFormat) -> Column:
    """Tokens of a chunk and the separator after it, counted as ``count_tokens`` says."""
    try:
        return token_count(chunk, fmt) + 1
    except ValueError:
        return F.size(token_array(chunk, fmt)) + F.when(column(chunk) == fmt.missing_str, fmt.missing_tokens - 1).otherwise(0)


def count_tokens(chunk_rows: DataFrame, fmt: TextFormat, n_tok: Column | None = None) -> DataFrame:
    """Add ``n_tok``: the tokens of the chunk and the separator after it.

    ``n_tok`` is an expression over ``chunk`` for a model that counts in its own
    way.  Without it, pieces led by one space are counted from the spaces, and in
    any other format the sign, every digit, the marker and the separator count one each.
    """
    if n_tok is None:
        n_tok = step_tokens("chunk", fmt)
    return chunk_rows.withColumn("n_tok", n_tok.cast("int"))


def suffix_tokens(chunk_rows: DataFrame, within: Column | None = None) -> DataFrame:
    """Add, per step, the tokens (``suffix_tok``) and steps (``suffix_steps``) from there to the end.

    Running sums from the last step back; the next-token contexts read the
    steps in the same direction, so both share one sort.
    """
    require_columns(chunk_rows, "i", "n_tok")
    to_end = newest_first(chunk_rows).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.lit(True) if within is None else within
    return chunk_rows.withColumns(
        {
            "suffix_tok": F.sum(F.when(inside, F.col("n_tok")).otherwise(0)).over(to_end),
            "suffix_steps": F.sum(F.when(inside, 1).otherwise(0)).over(to_end),
        }
    )


def _fits(tokens: Column, steps: Column, n_steps: int, context: int, multiplier: float) -> Column:
    average = tokens / (steps + 1)
    return tokens + F.lit(n_steps) * average * F.lit(float(multiplier)) < context


def packed_cut(
    step: T.DataType, n_steps: int, context: int = CONTEXT_TOKENS, multiplier: float = STEP_MULTIPLIER, within: str | None = None
) -> Column:
    """``cut`` as in ``mark_budget``, over an array ``steps`` (i, n_tok, ...) in step order.

    ``step`` is the type of i, ``within`` a field that says which steps count.
    """
    begin = F.struct(F.lit(0).cast("bigint").alias("tok"), F.lit(0).cast("bigint").alias("steps"), F.lit(None).cast(step).alias("cut"))

    def back(state: Column, s: Column) -> Column:
        inside = F.lit(True) if within is None else s[within]
        sums = F.struct(
            (state["tok"] + F.when(inside, s["n_tok"]).otherwise(0)).alias("tok"), (state["steps"] + F.when(inside, 1).otherwise(0)).alias("steps")
        )

        def marked(x: Column) -> Column:
            fits = inside & _fits(x["tok"], x["steps"], n_steps, context, multiplier)
            return F.struct(x["tok"].alias("tok"), x["steps"].alias("steps"), F.when(fits, s["i"]).otherwise(state["cut"]).alias("cut"))

        return bound_once(sums, marked)

    # from the newest step back: the last one that fits is the first of the text
    return F.aggregate(F.reverse("steps"), begin, back)["cut"]


def mark_budget(
    chunk_rows: DataFrame,
    n_steps: int,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    within: Column | None = None,
) -> DataFrame:
    """Add ``cut``: the first step from which prompt and expected answer fit the context.

    A text of s steps ends with a separator and so splits into s + 1 pieces;
    the average per step divides by that.  ``cut`` is NULL when not even the
    last step fits.  Steps outside ``within`` cost nothing and decide nothing.
    """
    rows = suffix_tokens(chunk_rows, within)
    fits = _fits(F.col("suffix_tok"), F.col("suffix_steps"), n_steps, context, multiplier)
    fits = fits if within is None else within & fits
    return rows.withColumn("cut", F.min(F.when(fits, F.col("i"))).over(by_key(chunk_rows)))


def truncate_to_budget(
    chunk_rows: DataFrame, n_steps: int, context: int = CONTEXT_TOKENS, multiplier: float = STEP_MULTIPLIER
) -> DataFrame:
    """Only the steps from the cut on; a series that does not fit at all appears in the report only."""
    marked = mark_budget(chunk_rows, n_steps, context, multiplier)
    return marked.where(F.col("i") >= F.col("cut")).select(*chunk_rows.columns)


def _report(fmt: TextFormat | None = None) -> list[Column]:
    kept = F.col("i") >= F.col("cut")
    n_kept, n_tokens = F.count_if(kept), F.coalesce(F.sum(F.when(kept, F.col("n_tok"))), F.lit(0))
    columns = [
        (F.count(F.lit(1)) - n_kept).alias("discarded"),
        n_kept.alias("kept"),
        n_tokens.alias("tokens"),
        F.when(n_kept > 0, n_tokens / (n_kept + 1)).alias("avg_tokens"),
        F.when(n_kept > 0, "ok").otherwise("does_not_fit").alias("status"),
    ]
    return columns if fmt is None else [joined_chunks(fmt, kept).alias("prompt"), *columns]


def packed_prompts(packed: DataFrame, fmt: TextFormat, carry: Sequence[str] = ()) -> DataFrame:
    """``prompts`` of rows that hold their ``steps`` (i, chunk, n_tok) as an array, and ``cut``."""
    require_columns(packed, "steps", "cut")
    keys = key_columns(packed)
    kept = bound_once(F.col("cut"), lambda cut: F.filter("steps", lambda s: s["i"] >= cut))
    rows = packed.select(*keys, *carry, F.size("steps").cast("bigint").alias("_all"), kept.alias("_kept"))
    n_kept = F.size("_kept").cast("bigint")
    rows = rows.select(
        *keys, *carry, "_all", n_kept.alias("kept"), kept_text("_kept", fmt).alias("prompt"),
        F.aggregate("_kept", F.lit(0).cast("bigint"), lambda n, s: n + s["n_tok"]).alias("tokens"),
    )
    return rows.select(
        *keys,
        "prompt",
        (F.col("_all") - F.col("kept")).alias("discarded"),
        "kept",
        "tokens",
        F.when(F.col("kept") > 0, F.col("tokens") / (F.col("kept") + 1)).alias("avg_tokens"),
        F.when(F.col("kept") > 0, "ok").otherwise("does_not_fit").alias("status"),
        *carry,
    )


def truncation_report(marked: DataFrame) -> DataFrame:
    """Per series: steps discarded and kept, tokens, tokens per step, status."""
    require_columns(marked, "i", "cut", "n_tok")
    return marked.groupBy(*key_columns(marked)).agg(*_report())


def prompts(marked: DataFrame, fmt: TextFormat, carry: Sequence[str] = ()) -> DataFrame:
    """The report with the text itself; ``carry`` names columns that are constant within a series."""
    require_columns(marked, "i", "cut", "n_tok", "chunk", *carry)
    return marked.groupBy(*key_columns(marked)).agg(*_report(fmt), *[F.max(c).alias(c) for c in carry])
