"""Helpers shared by the operators: tables in the shared folder, the session's limits, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions of this package travel with the job: executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules["numerale.llm"])

#: Rows of one Arrow batch: a batch of texts stays small beside an executor's memory.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one of this machine only where none is named."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="numerale-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/numerale/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: a lost executor costs no work before this point."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark takes it for one name, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct: an operator works beside it, so that no name of its own meets one of the user's."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as make it a new one."""
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that one Arrow batch carries to Python (a setting of the session, lowered only)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def schema_of(fields: str):
    """The Arrow schema of ``name type`` pairs, as used by the batch functions."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in fields.split(", "))])


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null gives the empty text."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): nodes reachable from each other share a component.

    Random contraction: in each round every node joins the neighbour (or stays)
    that comes first in an order drawn anew for the round, and the edges between
    the groups so formed are the next round's.  The graph shrinks by a constant
    share each round in expectation, whatever its shape; a node with very many
    neighbours is pre-aggregated, never gathered.  No edge reaches the driver.
    A component's number is one of its nodes, not always the smallest.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), f"{name}-edges")
    maps, mix = [], 0
    while not edges.isEmpty():
        mix = (mix * 6364136223846793005 + 1442695040888963407) % (1 << 63)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.col("b").bitwiseXOR(F.lit(mix))), F.col("a").bitwiseXOR(F.lit(mix)))
        chosen = both.groupBy("a").agg(first.bitwiseXOR(F.lit(mix)).alias("to"))
        chosen = stored(chosen.select(F.col("a").alias("node"), "to"), f"{name}-map")
        maps.append(chosen)
        left = chosen.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = chosen.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta != tb")
        small, large = F.least("ta", "tb"), F.greatest("ta", "tb")
        edges = stored(moved.select(small.alias("a"), large.alias("b")).distinct(), f"{name}-edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0].withColumnRenamed("to", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), "to")
        labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(labels, f"{name}-labels") if len(maps) > 1 else labels
