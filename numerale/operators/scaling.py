"""Scalers.  Every kind is affine, so a fitted scaler is one row (offset, scale):
``z = (x - offset) / scale`` and ``x = z * scale + offset``.

Two forms of the same expressions: ``fit_*`` returns a scaler table, and
``attach_scaler`` adds offset and scale to the rows of the series themselves
through a window, which needs neither a join nor a second read of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from numerale.functions import by_key, key_columns, require_columns
from numerale.functions.columns import column
from numerale.settings import SCALE_FLOOR

KINDS = ("identity", "gaussian", "basic", "advanced")

# Defaults of the scaling rule.
ALPHA = 0.95
BETA = 0.3


def advanced_offset(low: Column, high: Column, beta: Column | float) -> Column:
    return low - column(beta) * (high - low)


def nonzero(scale: Column) -> Column:
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def _scaler(
    kind: str, alpha: float, beta: float, missing: str, fit_on: Column | None, over: WindowSpec | None
) -> tuple[Column, Column]:
    """Offset and scale as aggregates, grouped or over a window."""
    if kind not in KINDS:
        raise ValueError(f"unknown scaler kind: {kind!r}; have {KINDS}")
    if missing not in ("skip", "propagate"):
        raise ValueError(f"unknown missing rule: {missing!r}")
    y = F.col("y") if fit_on is None else F.when(fit_on, F.col("y"))

    def agg(c: Column) -> Column:
        return c if over is None else c.over(over)

    if kind == "identity":
        offset, scale = F.lit(0.0), F.lit(1.0)
    elif kind == "gaussian":
        offset, scale = agg(F.avg(y)), agg(F.stddev_pop(y))
    elif kind == "basic":
        # greatest() skips NULL, so a series without values needs the guard
        quantile = agg(F.percentile(F.abs(y), F.lit(alpha)))
        offset, scale = F.lit(0.0), F.when(quantile.isNotNull(), F.greatest(quantile, F.lit(SCALE_FLOOR)))
    else:
        offset = advanced_offset(agg(F.min(y)), agg(F.max(y)), beta)
        scale = nonzero(agg(F.percentile(y, F.lit(alpha))) - offset)
    if missing == "propagate" and kind in ("gaussian", "advanced"):
        gap = F.col("y").isNull() if fit_on is None else fit_on & F.col("y").isNull()
        whole = agg(F.count_if(gap)) == 0
        offset, scale = F.when(whole, offset), F.when(whole, scale)
    return offset, scale


def fit_scaler(
    series: DataFrame,
    kind: str = "advanced",
    alpha: float = ALPHA,
    beta: float = BETA,
    missing: str = "skip",
    fit_on: Column | None = None,
) -> DataFrame:
    """One row ``(series_id, kind, offset, scale)`` per series.

    ``missing='propagate'`` gives a NULL scaler to a series with a gap, for
    the kinds that do not drop missing values themselves.  ``fit_on`` limits
    the rows the scaler sees (the training part, for example).
    """
    require_columns(series, "y")
    offset, scale = _scaler(kind, alpha, beta, missing, fit_on, None)
    aggregates = [F.count(F.lit(1)).alias("_rows"), offset.alias("offset"), scale.alias("scale")]
    keys = key_columns(series)
    if kind == "identity":
        aggregates = aggregates[:1]
    fitted = series.groupBy(*keys).agg(*aggregates)
    if kind == "identity":
        fitted = fitted.withColumns({"offset": offset, "scale": scale})
    return fitted.select(*keys, F.lit(kind).alias("kind"), "offset", "scale")


def fit_identity(series: DataFrame) -> DataFrame:
    return fit_scaler(series, "identity")


def fit_gaussian(series: DataFrame, missing: str = "skip") -> DataFrame:
    return fit_scaler(series, "gaussian", missing=missing)


def fit_basic(series: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return fit_scaler(series, "basic", alpha)


def fit_advanced(series: DataFrame, alpha: float = ALPHA, beta: float = BETA, missing: str = "skip") -> DataFrame:
    return fit_scaler(series, "advanced", alpha, beta, missing)


def attach_scaler(
    series: DataFrame,
    kind: str = "advanced",
    alpha: float = ALPHA,
    beta: float = BETA,
    missing: str = "skip",
    fit_on: Column | None = None,
) -> DataFrame:
    """Add ``offset`` and ``scale`` to every step of the series they belong to."""
    require_columns(series, "y")
    offset, scale = _scaler(kind, alpha, beta, missing, fit_on, by_key(series))
    return series.withColumns({"offset": offset, "scale": scale})


def attach_grid_scalers(
    series: DataFrame, grid: Sequence[dict], fit_on: Column | None = None, best: DataFrame | None = None
) -> DataFrame:
    """Add one copy of every step per grid point, with the point's parameters and 'advanced' scaler.

    Minimum, maximum and all quantiles come from one pass over the series;
    the grid is a literal array, so no join is made and the layout is kept.
    With ``best(series_id, pid)`` every series gets its own point only; a series without one keeps its
    steps, without parameters and scaler.
    """
    require_columns(series, "y")
    y = F.col("y") if fit_on is None else F.when(fit_on, F.col("y"))
    alphas = sorted({p["alpha"] for p in grid})
    own = by_key(series)
    stats = series.withColumns(
        {
            "_low": F.min(y).over(own),
            "_high": F.max(y).over(own),
            "_quantiles": F.percentile(y, F.array(*map(F.lit, alphas))).over(own),
        }
    )
    return _with_points(stats, series.columns, grid, alphas, best)


def pack_grid_scalers(
    series: DataFrame,
    grid: Sequence[dict],
    fit_on: Column | None = None,
    best: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``attach_grid_scalers`` as one row per series and grid point, with its steps as an array.

    ``steps`` holds (i, y, fit) in step order, ``fit`` says whether the scaler has seen the step.  The steps are
    gathered before the grid multiplies them, so that no sort or shuffle holds more than the series itself; a
    series is bounded by the calendar.  ``carry`` names columns that are constant within a series.
    """
    require_columns(series, "series_id", "i", "y", *carry)
    fit = F.lit(True) if fit_on is None else F.coalesce(fit_on, F.lit(False))
    y = F.col("y") if fit_on is None else F.when(fit_on, F.col("y"))
    alphas = sorted({p["alpha"] for p in grid})
    packed = series.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "y", fit.alias("fit")))).alias("steps"),
        F.min(y).alias("_low"),
        F.max(y).alias("_high"),
        F.percentile(y, F.array(*map(F.lit, alphas))).alias("_quantiles"),
        *[F.max(c).alias(c) for c in carry],
    )
    return _with_points(packed, ["series_id", "steps", *carry], grid, alphas, best)


def _with_points(stats: DataFrame, columns: Sequence[str], grid: Sequence[dict], alphas: Sequence[float], best: DataFrame | None) -> DataFrame:
    """Rows with ``_low``, ``_high`` and ``_quantiles`` (of ``alphas``), once per grid point or with the best one."""
    if best is None:
        rows = stats.select("*", F.explode(grid_literal(grid)).alias("_p"))
    else:
        # both sides are laid out by series already; pid only picks from the literal
        chosen = stats.join(best.select("series_id", F.col("pid").alias("_pid")), "series_id", "left")
        rows = chosen.withColumn("_p", F.when(F.col("_pid").isNotNull(), F.element_at(grid_literal(grid), F.col("_pid") + 1)))
    # the position of alpha among the quantiles is known when the plan is built
    rank = F.element_at(F.array(*[F.lit(alphas.index(p["alpha"])) for p in grid]), F.col("_p.pid") + 1)
    offset = advanced_offset(F.col("_low"), F.col("_high"), F.col("_p.beta"))
    return rows.select(
        *columns,
        "_p.*",
        offset.alias("offset"),
        nonzero(F.get("_quantiles", rank) - offset).alias("scale"),
    )


def grid_literal(grid: Sequence[dict]) -> Column:
    """A parameter grid as an array of structs (pid, alpha, beta, prec, temp)."""
    return F.array(
        *[
            F.struct(
                F.lit(p["pid"]).alias("pid"),
                F.lit(float(p["alpha"])).alias("alpha"),
                F.lit(float(p["beta"])).alias("beta"),
                F.lit(p["prec"]).alias("prec"),
                F.lit(float(p["temp"])).alias("temp"),
            )
            for p in grid
        ]
    )


def scaled(x: Column | str = "y") -> Column:
    """NULL where the scaler is missing or has no spread."""
    return F.try_divide(column(x) - F.col("offset"), F.col("scale"))


def unscaled(z: Column | str = "z") -> Column:
    return column(z) * F.col("scale") + F.col("offset")


def _with_scaler(df: DataFrame, scalers: DataFrame) -> DataFrame:
    on = [c for c in key_columns(scalers) if c in df.columns]
    # scalers grow with the number of series: Spark broadcasts them only below its size threshold
    return df.join(scalers.select(*on, "offset", "scale"), on, "left")


def transform(df: DataFrame, scalers: DataFrame, col: str = "y", into: str = "z") -> DataFrame:
    """Scale a column with the scaler of its series."""
    return _with_scaler(df, scalers).withColumn(into, scaled(col)).drop("offset", "scale")


def inverse(df: DataFrame, scalers: DataFrame, col: str = "z", into: str = "x") -> DataFrame:
    """Undo ``transform``."""
    return _with_scaler(df, scalers).withColumn(into, unscaled(col)).drop("offset", "scale")


def log_slope(scalers: DataFrame) -> DataFrame:
    """Mean log-derivative of each scaler: the map is affine, so it is -ln(scale) at every point."""
    return scalers.withColumn("log_slope", F.when(F.col("scale") > 0, -F.ln("scale")))
