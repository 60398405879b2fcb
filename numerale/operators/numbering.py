"""Row numbers of a whole table without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of the order should hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1024
#: Borders looked at for each range.
CANDIDATES = 32


def number_rows(rows: DataFrame, order: Sequence[Column], into: str = "step", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add 0, 1, ... in the given order (nulls first); rows that tie in all of it are numbered in any order.

    The order is cut into ranges at values drawn by a hash from the distinct ones (at most some
    ``MOST_RANGES * CANDIDATES`` of them are looked at); each range is numbered by itself, on top of the
    number of rows in the ranges before.  Which range a row is in follows from its values alone, so the
    two passes agree however the rows are dealt.  ``rows`` is read three times: write it first if it is costly.
    """
    keyed = rows.withColumn("_key", F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)]))
    total = rows.count()
    ranges = min(MOST_RANGES, -(-total // range_rows))
    bounds = []
    if ranges > 1:
        # every so-manieth distinct key, told by its hash: ties count once
        share = max(1, total // (ranges * CANDIDATES))
        drawn = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(share)) == 0).select("_key").distinct()
        drawn = [r._key for r in drawn.orderBy("_key").limit(MOST_RANGES * CANDIDATES * 4).collect()]
        bounds = [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if len(drawn) >= ranges else drawn
    if bounds:
        kind = keyed.select("_key").schema.simpleString()[len("struct<_key:") : -1]
        borders = rows.sparkSession.createDataFrame([([tuple(b) for b in bounds],)], f"borders array<{kind}>")
        # one row: the borders of at most MOST_RANGES ranges
        keyed = keyed.join(F.broadcast(borders)).withColumn("_range", F.size(F.filter("borders", lambda b: b <= F.col("_key")))).drop("borders")
    else:
        # one range; not a literal, which would make the window one without a key
        keyed = keyed.withColumn("_range", F.pmod(F.xxhash64("_key"), F.lit(1)).cast("int"))
    counts = {r._range: r.n for r in keyed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, so_far = [], 0
    for k in range(len(bounds) + 1):
        before.append(so_far)
        so_far += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    number = place.cast("bigint") + F.element_at(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("_range") + 1) - 1
    return keyed.withColumn(into, number).drop("_key", "_range")
