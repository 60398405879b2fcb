"""Sums of doubles that do not depend on the order of addition.

A double is cut into whole digits of ``BAND`` bits at fixed places (band b stands for
2 ** (BAND * b)), which is exact.  Digits of one band are whole numbers, so their
sums are the same however the rows are dealt to tasks; the sums of the bands are put together in
one order, from the lowest band to the highest.  A sum of more than 2 ** 38 values of one
sign and band could leave the range of BIGINT: that is an error under ANSI, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 24
#: Bands of a value, at most: 53 bits, a rounded logarithm.
DIGITS = 5
#: Values outside these powers of two are moved by SHIFT bands first, so that no power used overflows.
FAR, SHIFT = 500, 20
LOWEST, HIGHEST = -30, 24
#: The band under which rows are counted.
COUNT = -1000


def _power(band: Column) -> Column:
    """2 ** (BAND * band), from a list: exact on every machine."""
    return F.element_at(F.array(*[F.lit(2.0 ** (BAND * b)) for b in range(LOWEST, HIGHEST + 1)]), band - LOWEST + 1)


def with_digits(rows: DataFrame, col: str, into: str = "_digits") -> DataFrame:
    """Add the digits of a finite column as (band, digit), and one entry that counts the value; NULL counts 0."""
    x = F.col(col).cast("double")
    large, small = F.abs(x) >= 2.0**FAR, F.abs(x) < 2.0**-FAR
    moved = F.when(large, x * 2.0 ** (-BAND * SHIFT)).when(small, x * 2.0 ** (BAND * SHIFT)).otherwise(x)
    by = F.when(large, SHIFT).when(small, -SHIFT).otherwise(0)
    out = rows.withColumns({"_x": x, "_rest": moved, "_by": by})
    top = F.floor(F.ln(F.abs("_rest")) / F.ln(F.lit(2.0)) / BAND).cast("int") + 1
    out = out.withColumn("_top", F.when(F.col("_x") != 0, top))
    for k in range(DIGITS):
        out = out.withColumn("_p", _power(F.col("_top") - k)).withColumn("_q", F.col("_rest") / F.col("_p"))
        digit = F.when(F.col("_q") < 0, F.ceil("_q")).otherwise(F.floor("_q"))
        out = out.withColumn(f"_d{k}", digit).withColumn("_rest", F.col("_rest") - F.col(f"_d{k}") * F.col("_p"))
    digits = [F.when(F.col(f"_d{k}") != 0, F.struct((F.col("_top") - k + F.col("_by")).alias("band"), F.col(f"_d{k}").alias("digit"))) for k in range(DIGITS)]
    counted = F.struct(F.lit(COUNT).alias("band"), F.when(F.col("_x").isNull(), 0).otherwise(1).cast("bigint").alias("digit"))
    out = out.withColumn(into, F.array_compact(F.array(counted, *digits)))
    return out.select(*rows.columns, into)


def _value(entry: Column) -> Column:
    """A band's sum as a double."""
    band, total = entry["band"], entry["total"].cast("double")
    near = F.when(band > SHIFT, band - SHIFT).when(band < -SHIFT, band + SHIFT).otherwise(band)
    far = F.when(band > SHIFT, F.lit(2.0 ** (BAND * SHIFT))).when(band < -SHIFT, F.lit(2.0 ** (-BAND * SHIFT))).otherwise(F.lit(1.0))
    return total * _power(near) * far


def exact_mean(rows: DataFrame, keys: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """The mean of each column per group, NULL values skipped, with the same bits however the rows lie."""
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = rows.select(*named, F.inline(values))
    names = [c for c in rows.columns if c not in ("c", "x")]
    # never empty; inline_outer, as a filter on the digits would be pushed down and compute them again
    each = with_digits(rows, "x").select(*names, "c", F.inline_outer("_digits"))
    bands = each.groupBy(*names, "c", "band").agg(F.sum("digit").alias("total"))
    merged = bands.groupBy(*names).agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("band", "total")))).alias(c) for c in cols])

    def mean(c: str) -> Column:
        # the count comes first: its band is the lowest
        total = F.aggregate(F.slice(c, 2, F.size(c)), F.lit(0.0), lambda acc, e: acc + _value(e))
        return total / F.nullif(F.element_at(c, 1)["total"], F.lit(0))

    return merged.select(*names, *[mean(c).alias(c) for c in cols])
