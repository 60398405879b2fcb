"""Session settings the jobs are written for; used by tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: All are defaults a cluster can keep; none is needed for right results but the time zone
#: (weeks of zoned timestamps) and the adaptive settings decide how skew is handled.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the weekly rows that are shuffled are few beside the texts and tokens made of them afterwards:
    # keep their partitions, so that this work stays spread
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # no Python call site per column expression: building a plan takes half the time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("numerale")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
