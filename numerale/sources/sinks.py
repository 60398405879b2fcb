from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a result as Parquet; partition by columns with few values (a kind, a model), never by series.

    ``mode='replace_parts'`` replaces the partitions that ``df`` has rows of and leaves the others, so that a job
    that is run again leaves one copy of its rows.
    """
    writer = df.write
    if mode == "replace_parts":
        if not partition_by:
            raise ValueError("mode 'replace_parts' needs partition_by")
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, by: Sequence[str] = ("series_id",), mode: str = "overwrite") -> None:
    """Write a table laid out by series: joins, windows and groups by the same columns need no shuffle on reading it back.

    The rows are dealt to the buckets before, so that each task writes one bucket's file.
    """
    df.repartition(buckets, *by).write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
