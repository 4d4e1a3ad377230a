"""Bounded, reproducible samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold

#: Rows whose crc32(doc_id as text) modulo FOLDS is 0 are held out and never learnt from.
FOLDS = 5


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) outside the held-out fold, each id once; null labels and ids are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))


def least_hashes(rows: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` of n rows, those of the smallest id hashes.

    Rows over a hash that about `most` rows stay under are dropped where they are, so the last task sees little more than
    it keeps, however many partitions there are.
    """
    span = 1 << 30
    share = min(span, int(span * (most + 8 * most**0.5 + 16) / max(1, n)) + 1)
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(span)), "doc_id").limit(most)


def sample_labels(labels: DataFrame, label: str, each: int) -> DataFrame:
    """At most each rows of either class outside the held-out fold, those of the smallest id hashes.

    A bounded table (2 * each rows of two numbers), so that it may be broadcast.
    """
    known = known_labels(labels, label)
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [least_hashes(known.filter(F.col("label") == y), n.get(y, 0), each) for y in (0, 1)]
    return picked[0].union(picked[1])


def share_of_ones(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all rows outside the held-out fold; 0.5 if there are none."""
    known = labels.filter(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0))
    found = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if found is None else float(found)
