"""A training corpus from raw documents: STAGES, each on what the stage before kept, written and read again.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination,
packing.  All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerale.llm import decontaminate, line_dedup, packing, quality, simhash
from numerale.llm.common import free_name, load, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, scores below the threshold go."""
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    score = free_name("score", docs.columns)
    kept = quality.scored(docs, model).where(F.col(score) >= quality.THRESHOLD)
    return kept.drop(score)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs go; n_chars follows the text where it changed."""
    out = line_dedup.remove_repeated_lines(docs)
    removed = free_name("lines_removed", docs.columns)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).drop(removed)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their ids."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", deduplicate_lines),
    ("SimHash near-dedup", deduplicate_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs


#: The rows of run() depend on a trained classifier, on fingerprints and on token ids: SQL can't express them.
ORACLE_SQL = None
