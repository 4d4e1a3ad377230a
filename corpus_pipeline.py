"""From raw documents to packed batches: the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, table
from ledgerlens.llm.mixing import emit
from ledgerlens.llm.near_dedup import drop_copies
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality_rules import quality_rules
from ledgerlens.llm.toxicity import drop_toxic

#: Likeness, in hundredths, from which the dedup stage holds documents for near-duplicates; 85 binds the query of op5 alone.
SIMILARITY = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that a quality rule rejects go."""
    row = docs.select(F.struct(*COLUMNS).alias("doc_id"), "text")
    return quality_rules(row).filter("kept").select("doc_id.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score over the threshold of their language go."""
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near-duplicates stays.

    Rows equal in id and text count once; documents without an id belong to no group and stay.
    """
    return drop_copies(docs.select(*COLUMNS), SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it."""
    return emit(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: length buckets and token-budget batches."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("near_dedup", dedup), ("mixing", mixing), ("packing", packing)]

#: The toxicity model and the bucket bounds are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
