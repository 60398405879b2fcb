from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from numerale.functions.columns import column


def week_end(ts: Column | str) -> Column:
    """The Sunday on or after a date: the label of the week that ends on it."""
    return F.date_sub(F.next_day(F.to_date(column(ts)), "MON"), 1)
