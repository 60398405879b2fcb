"""Time series as text, on Spark: many series at once, keyed by ``series_id``."""

from numerale.settings import TextFormat

__all__ = ["TextFormat"]
