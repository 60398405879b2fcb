"""Series to text and completions back to numbers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.functions import (
    bound_once,
    decimal_digits,
    decode_chunk,
    greedy_digits,
    key_columns,
    overflows,
    require_columns,
    signed_chunk,
    spaced_digits,
    split_chunks,
    with_greedy_digits,
)
from numerale.operators.scaling import scaled
from numerale.settings import TextFormat


def prec_of(df: DataFrame) -> Column | None:
    """A grid carries ``prec`` as a column; otherwise the format decides."""
    return F.col("prec") if "prec" in df.columns else None


def digits(df: DataFrame, fmt: TextFormat, col: str = "z") -> DataFrame:
    """Add the digits of a scaled value, run together, and whether it outgrew the integer positions."""
    prec, overflow = prec_of(df), overflows(col, fmt)
    if fmt.digit_mode == "greedy":
        spaced = with_greedy_digits(df, col, fmt, prec)
        text = F.replace("_spaced", F.lit(fmt.bit_sep), F.lit("")) if fmt.bit_sep else F.col("_spaced")
        return spaced.withColumns({"digits": text, "overflow": overflow}).drop("_spaced")
    return df.withColumns({"digits": decimal_digits(col, fmt, prec), "overflow": overflow})


def digit_arrays(df: DataFrame, fmt: TextFormat, col: str = "z") -> DataFrame:
    """Add the digits of a scaled value as an array, one entry per position; NULL where the value is missing."""
    spread = replace(fmt, bit_sep=" ")
    if fmt.digit_mode == "greedy":
        rows = with_greedy_digits(df, col, spread, prec_of(df))
    else:
        rows = df.withColumn("_spaced", spaced_digits(col, spread, prec_of(df)))
    return rows.withColumn("digit_array", F.split(F.ltrim("_spaced"), " ")).drop("_spaced")


def encode(df: DataFrame, fmt: TextFormat) -> DataFrame:
    """Scale ``y`` with the row's own offset and scale, and write it as a chunk."""
    require_columns(df, "y", "offset", "scale")
    return chunks(df.withColumn("z", scaled("y")), fmt)


def chunks(df: DataFrame, fmt: TextFormat, col: str = "z") -> DataFrame:
    """Add the text of one step to every row."""
    if fmt.digit_mode == "greedy":
        spaced = with_greedy_digits(df, col, fmt, prec_of(df))
        return spaced.withColumn("chunk", signed_chunk(col, F.col("_spaced"), fmt)).drop("_spaced")
    return df.withColumn("chunk", signed_chunk(col, spaced_digits(col, fmt, prec_of(df)), fmt))


def chunk_of(y: Column, fmt: TextFormat, prec: Column | None = None) -> Column:
    """The text of one step as an expression, for values inside arrays: ``encode`` with the row's offset and scale."""
    spaced = greedy_digits if fmt.digit_mode == "greedy" else spaced_digits
    return bound_once(scaled(y), lambda z: signed_chunk(z, spaced(z, fmt, prec), fmt))


def kept_text(steps: Column | str, fmt: TextFormat) -> Column:
    """The text of an array of steps in order, each chunk followed by the separator."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["chunk"], F.lit(fmt.time_sep))), "")


def joined_chunks(fmt: TextFormat, kept: Column | None = None) -> Column:
    """Aggregate: the chunks of a group in step order, each followed by the separator.

    The order comes from sorting inside the aggregate; a group is one series,
    bounded by the calendar and, after truncation, by the token budget.
    """
    step = F.struct("i", F.concat("chunk", F.lit(fmt.time_sep)).alias("text"))
    # collect_list leaves out NULL, so rows that are not kept take no memory
    steps = F.array_sort(F.collect_list(step if kept is None else F.when(kept, step)))
    return F.array_join(F.transform(steps, lambda s: s["text"]), "")


def series_string(chunk_rows: DataFrame, fmt: TextFormat) -> DataFrame:
    """One text per series (and grid point)."""
    require_columns(chunk_rows, "i", "chunk")
    return chunk_rows.groupBy(*key_columns(chunk_rows)).agg(joined_chunks(fmt).alias("text"))


def split_completion(completions: DataFrame, fmt: TextFormat) -> DataFrame:
    """Completed steps of every sample, one row each."""
    carried = [c for c in completions.columns if c != "text"]
    return completions.select(*carried, F.posexplode(split_chunks("text", fmt)).alias("step", "chunk"))


def decode_steps(steps: DataFrame, fmt: TextFormat) -> DataFrame:
    """Add the number of each step; a chunk that cannot be read is flagged, never raised."""
    z = decode_chunk("chunk", fmt, prec_of(steps))
    return steps.withColumn("z", z).withColumn("malformed", F.col("z").isNull())


def decode_completions(completions: DataFrame, fmt: TextFormat) -> DataFrame:
    """Whole samples at once, without exploding them.

    Adds ``zs`` (the numbers, NULL where malformed) and ``usable``: a sample
    counts up to its first malformed step.  A sample without a finished step
    stays, with ``usable = 0``.
    """
    prec = prec_of(completions)
    values = F.transform(split_chunks("text", fmt), lambda c: decode_chunk(c, fmt, prec))
    first_bad = F.array_position(F.transform(F.col("zs"), lambda v: v.isNull()), True).cast("int")
    return (
        completions.withColumn("zs", values)
        .withColumn("usable", F.when(first_bad > 0, first_bad - 1).otherwise(F.size("zs")))
        .drop("text")
    )
