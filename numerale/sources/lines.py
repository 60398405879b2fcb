"""Observations, predictions, completions and scores that arrive as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The raw line, where it does not read as the schema says.
CORRUPT = "_corrupt"

OBSERVATION_LINE = "series_id STRING, ts TIMESTAMP_NTZ, value DOUBLE"
COMPLETION_LINE = "series_id STRING, pid INT, sample_id INT, text STRING"


def parse_csv_lines(lines: DataFrame, col: str = "line", schema: str = OBSERVATION_LINE, **options: str) -> DataFrame:
    """One row per line with the schema's columns and ``_corrupt``: a line that is not as the schema says keeps what could
    be read and has itself there.  Other columns are passed on."""
    return _parsed(lines, col, lambda c, s, o: F.from_csv(c, s, o), schema, options)


def parse_json_lines(lines: DataFrame, col: str = "line", schema: str = COMPLETION_LINE, **options: str) -> DataFrame:
    """The same for JSON objects, one a line."""
    return _parsed(lines, col, lambda c, s, o: F.from_json(c, s, o), schema, options)


def _parsed(lines, col, read, schema, options):
    found = read(F.col(col), f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options})
    return lines.withColumn("_line", found).select(*[c for c in lines.columns if c != col], "_line.*")


def accepted(parsed: DataFrame) -> DataFrame:
    """The lines that were read whole."""
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(parsed: DataFrame) -> DataFrame:
    """The raw lines that were not, to be written aside."""
    return parsed.where(F.col(CORRUPT).isNotNull()).select(*[c for c in parsed.columns if c == CORRUPT])
