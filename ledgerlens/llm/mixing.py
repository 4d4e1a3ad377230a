"""Operator 6, mixing sources to target weights.

Sizes are summed by source; water filling turns weights into targets; a document is emitted floor(rate) times and
once more where a uniform number seeded by its id lies below the rate's fraction.  The aggregate has a row for each
source, so the only global window runs over as many rows as there are sources.

The aims meet the rows by broadcast if there are at most SOURCES of them, so that no text moves; beyond, by a join.

Defined results: a null text has size 0; a null source is a source of its own, last; a row with a null id draws by the
hash of its text; equal rows take equal copies; a source of size 0 has target 0 and takes nothing; an empty table gives an empty
result; other columns are passed through by emit() and not read by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, n_words

#: Most sources whose aims are broadcast, a few dozen bytes each.
SOURCES = 1 << 16


def name_of(doc_id: Column, text: Column) -> Column:
    """What a row draws by: its id, or the hash of its text if the id is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))))


def uniform(name: Column, seed: str) -> Column:
    """A number in [0, 1) of 32 bits from the md5 of the seed and the name of a row."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target of a table (source, source_size) with one row for each source.

    Water filling in closed form: in ascending order of size / weight the sources before some point stop at
    most times their size, the others get level times their weight; the level of the first point that leaves
    every later source below its limit is the one that holds.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code) - 1) % len(weights)) + 1).cast("long").alias("weight"))
    order = (F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = weighted.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    levelled = summed.withColumn("level", (F.col("total") - most * F.col("size_before")) / F.col("weight_left"))
    holds = F.col("level") * F.col("weight") <= most * F.col("source_size")
    return levelled.withColumn("level", F.first(F.when(holds, F.col("level")), ignorenulls=True).over(every)).select(
        "source", "source_size", F.coalesce(F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target")
    )


def plan(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies times size) of every document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), name_of(F.col(id_col), F.col(text_col)).alias("name"))
    sized = scratch.put(sized, "sized")
    aims = scratch.put(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "aims")
    return rates(sized, aims, seed).drop("name")


def rates(sized: DataFrame, aims: DataFrame, seed: str) -> DataFrame:
    """Copies of each row of sized (with name, source, size) under the aims of its source."""
    few = aims.count() <= SOURCES
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target", (F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).alias("rate"))
    joined = sized.join(F.broadcast(aims) if few else aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.floor("rate") + (uniform(F.col("name"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.coalesce(copies, F.lit(0).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows: each row of docs, all its columns unchanged, as often as its copies say."""
    size = n_words(F.col(text_col)).alias("size")
    aims = targets(docs.select(F.col(source_col).alias("source"), size).groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = Scratch(docs.sparkSession, "mixing").put(aims, "aims")
    row = docs.select(F.struct("*").alias("_row"), name_of(F.col(id_col), F.col(text_col)).alias("name"), F.col(source_col).alias("source"), F.lit(0).cast("long").alias("size"))
    repeated = rates(row, aims, seed).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_row.*")
