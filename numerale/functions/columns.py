"""Helpers on column names shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, not while it runs, when a column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def key_columns(df: DataFrame) -> list[str]:
    """``series_id``, and ``pid`` when the rows belong to points of a parameter grid."""
    require_columns(df, "series_id")
    return [c for c in ("series_id", "pid") if c in df.columns]


def by_key(df: DataFrame) -> WindowSpec:
    """Window over one series (and grid point).

    A weekly series has at most as many steps as the DATE calendar has weeks
    (about 522,000), whatever the number of observations behind it, so the
    partition of such a window is bounded and sorts spill if they must.
    """
    return Window.partitionBy(*key_columns(df))


def newest_first(df: DataFrame) -> WindowSpec:
    """The steps of one series from the last one back."""
    return by_key(df).orderBy(F.desc("i"))


def column(value: Column | str | int | float) -> Column:
    """Strings name columns, numbers are literals, columns pass through."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, through a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)
