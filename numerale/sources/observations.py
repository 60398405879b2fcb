"""Observations and benchmark predictions in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numerale.functions import require_columns
from numerale.functions.columns import column
from numerale.operators.numbering import number_rows

#: Header of the observation files: a date text and the target.
OBSERVATION_FILE = T.StructType([T.StructField("Date", T.StringType()), T.StructField("tmax", T.DoubleType())])


def _strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with header as text columns: names come from the header, nothing is inferred or dropped."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_observations(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, time_col: str = "Date"
) -> DataFrame:
    """CSV with a header row, bound by name: ``time_col`` as text, every other column as a number.

    With ``schema`` the file must have exactly its columns.  Values that are no
    numbers become NULL; ``rejected_values`` counts them.
    """
    if schema is not None:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    raw = _strings(spark, path)
    if time_col not in raw.columns:
        raise ValueError(f"no column {time_col!r} in the header: {raw.columns}")
    return raw.select(*[F.col(f"`{c}`") if c == time_col else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns])


def rejected_values(spark: SparkSession, path: str | list[str], text_cols: Sequence[str] = ("Date",)) -> DataFrame:
    """Per column of a CSV, the values that are given but are no numbers."""
    raw = _strings(spark, path)
    names = [c for c in raw.columns if c not in text_cols]
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in names]
    return raw.agg(*bad).unpivot([], names, "column", "rejected")


def read_predictions(
    spark: SparkSession, path: str | list[str], models: Sequence[str] | None = None, truth: str = "test"
) -> DataFrame:
    """Wide benchmark CSV, bound by header name: ``step``, the truth and one column per model.

    The first column is the index, whatever it holds and however it is called:
    the rows are numbered in its order (as numbers, then as dates, then as text),
    so a date index gives steps 0, 1, ... too.  ``models`` keeps some columns only.
    """
    raw = _strings(spark, path)
    index, names = raw.columns[0], raw.columns[1:]
    missing = [c for c in (truth, *(models or [])) if c not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in the header: {raw.columns}")
    first = F.col(f"`{index}`")
    kept = [truth, *(models if models is not None else [c for c in names if c != truth])]
    values = [F.col(f"`{c}`").try_cast("double").alias(c) for c in kept]
    index_col = F.col("_index")
    order = [index_col.try_cast("double"), index_col.try_cast("timestamp_ntz"), index_col]
    numbered = number_rows(raw.select(first.alias("_index"), *values), order)
    return numbered.select(F.col("step").cast("int").alias("step"), *[f"`{c}`" for c in kept])


def _parsed(text: Column, fmt: str | None) -> Column:
    if fmt is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_time(df: DataFrame, col: str, fmt: str | None = None, into: str = "ts") -> DataFrame:
    """Add the parsed time; text that is no time becomes NULL (see ``rejected_times``)."""
    return df.withColumn(into, _parsed(F.col(col), fmt))


def rejected_times(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """The rows ``parse_time`` cannot read, to be written aside."""
    return df.where(F.col(col).isNotNull() & _parsed(F.col(col), fmt).isNull())


def _no_number(name: str) -> Column:
    return F.isnan(name) | (F.abs(name) == float("inf"))


def rejected_observations(
    df: DataFrame, id_cols: Sequence[str | Column], ts_col: str, value_cols: str | Sequence[str]
) -> DataFrame:
    """What ``as_series`` leaves out or turns into NULL, as counts in one row."""
    names = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    ids = [column(c) for c in id_cols]
    no_id = ids[0].isNull() if len(ids) == 1 else F.lit(False)  # a struct of nulls is an id
    types = dict(df.dtypes)
    bad = [F.coalesce(_no_number(n), F.lit(False)) for n in names if types[n] in ("double", "float")]
    return df.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col(ts_col).isNull()).alias("without_time"),
        F.count_if(no_id).alias("without_id"),
        sum([F.count_if(b) for b in bad], F.lit(0)).cast("bigint").alias("no_number"),
        sum([F.count_if(F.col(n).isNull()) for n in names], F.lit(0)).cast("bigint").alias("missing_values"),
    )


def as_series(
    df: DataFrame, id_cols: Sequence[str | Column], ts_col: str, value_cols: str | Sequence[str]
) -> DataFrame:
    """Bind any table as observations ``(series_id, ts, value...)``.

    One id column keeps its type, so grouping runs on the native key; several
    become a struct, which cannot collide the way joined text can.  NaN and
    infinite values are turned into NULL here, once, because they would win every
    ``max`` and cannot be written.  Rows without a time or an id belong to no step
    of any series and are left out (``rejected_observations`` counts both); said here, the filter is the same in every use of the series, so that
    Spark can share one scan and shuffle between them.
    """
    if not id_cols:
        raise ValueError("need at least one id column")
    ids = [column(c) for c in id_cols]
    series_id = ids[0] if len(ids) == 1 else F.struct(*ids)
    names = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    require_columns(df, ts_col, *names)
    types = dict(df.dtypes)

    def value(name: str) -> Column:
        if types[name] in ("double", "float"):
            return F.when(~_no_number(name), F.col(name).cast("double"))
        return F.col(name)

    out = ["value"] if len(names) == 1 else names
    bound = df.select(
        series_id.alias("series_id"), F.col(ts_col).alias("ts"), *[value(n).alias(o) for n, o in zip(names, out)]
    )
    return bound.where(F.col("ts").isNotNull() & F.col("series_id").isNotNull())
