"""Operator 2, packing into optimal length buckets.

The histogram of all lengths has at most about 1,600 bins (exact up to 256 words, then 64 bins an octave), each with
its count, sum and largest length; dynamic programming over the bins chooses the bucket bounds of least padding.
The budget is the last bound there can be: sequences over it stay out of the histogram.  Inside a bucket, batches hold
floor(token budget / bound) rows each.  Positions come from counts of small chunks and their prefix sums, so no task
holds a bucket; rows of one id, or of none, are spread by a number of their own.

Defined results: a null text is an empty sequence of length 0; a sequence longer than the budget is a batch of its own
(oversize, in a last bucket without padding); equal rows take different slots; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, id_text, n_words

EXACT = 256
OCTAVE = 64
CHUNK_ROWS = 1024


def bin_of(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(EXACT + F.floor(F.log2(n / F.lit(EXACT)) * OCTAVE)).cast("int")


def best_bounds(count: np.ndarray, total: np.ndarray, most: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds, ascending, of least padding; bins are given in ascending order of length.

    cost(i, j): padding of bins i..j-1 in one bucket, whose bound is the largest length of bin j-1.
    """
    n = len(count)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    cost = most[None, :].astype(float) * (c[1:][None, :] - c[:-1][:, None]) - (s[1:][None, :] - s[:-1][:, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, cuts = cost[0], []
    for _ in range(min(buckets, n) - 1):
        through = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        cut = through.argmin(0)
        least = through[cut, np.arange(n)]
        cut[best <= least] = 0
        cuts.append(cut)
        best = np.minimum(best, least)
    j, bounds = n - 1, []
    for cut in reversed(cuts):
        if j < 0:
            break
        if cut[j]:
            bounds.append(int(most[j]))
            j = int(cut[j]) - 1
    bounds.append(int(most[j]))
    return sorted(set(bounds))


def pack(docs: DataFrame, budget: int = 8192, buckets: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, padded_len, batch_id, slot and oversize of every row.

    Rows of one batch_id are padded to padded_len; together they hold at most budget tokens, padding included,
    except an oversize row, which stands alone.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    sized = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_tokens"), F.monotonically_increasing_id().alias("_row"))
    sized = scratch.put(sized, "sized")
    n, over = F.col("n_tokens"), F.col("n_tokens") > budget
    bins = sized.groupBy(over.alias("over"), F.when(~over, bin_of(n)).alias("bin")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("m")).orderBy("bin").collect()
    alone = sum(b["n"] for b in bins if b["over"])
    count, total, most = (np.array([b[k] for b in bins if not b["over"]], dtype=np.int64) for k in ("n", "s", "m"))
    bounds = best_bounds(count, total, most, buckets) or [0]
    rows = [int(count[(most <= b) & (most > (bounds[i - 1] if i else -1))].sum()) for i, b in enumerate(bounds)]

    bucket = F.when(over, len(bounds)).otherwise(sum(((n > b).cast("int") for b in bounds[:-1]), F.lit(0)))
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)
    dealt = (
        sized.withColumn("bucket", bucket)
        .withColumn("padded_len", F.when(over, n).otherwise(pick([*bounds, 0], "long")))
        .withColumn("room", pick([*[max(1, budget // max(1, b)) for b in bounds], 1], "long"))
        .withColumn("_hash", F.xxhash64(id_text(F.col("doc_id")), n, F.col("_row")))
        .withColumn("chunk", F.pmod("_hash", pick([max(1, -(-r // CHUNK_ROWS)) for r in [*rows, alone]], "long")))
    )
    counts = dealt.groupBy("bucket", "chunk").agg(F.count("*").alias("_rows"))
    offsets = counts.select("bucket", "chunk", (F.sum("_rows").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_offset"))
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("_hash", "_row")) - 1)
    placed = inside.join(offsets, ["bucket", "chunk"]).withColumn("_at", F.col("_at") + F.col("_offset"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_len",
        (F.shiftleft(F.col("bucket").cast("long"), 40) + F.floor(F.col("_at") / F.col("room"))).alias("batch_id"),
        F.pmod("_at", "room").alias("slot"),
        over.alias("oversize"),
    )
