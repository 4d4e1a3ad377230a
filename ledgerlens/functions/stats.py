"""Statistics as column expressions: every one gives NULL where its sample is too small, never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the duration bins in seconds; a seventh bin has no end.
DURATION_ENDS = (60, 300, 3600, 21600, 86400, 604800)


def quantile(x: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p."""
    return F.percentile(x, p)


def cv(x: Column) -> Column:
    """Population standard deviation over the mean; NULL below two values or at mean 0."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)))


def skewness(x: Column) -> Column:
    """Population skewness of three values or more; 0 without spread."""
    return F.when(F.count(x) >= 3, F.when(F.stddev_pop(x) == 0, 0.0).otherwise(F.skewness(x)))


def kurtosis(x: Column) -> Column:
    """Population excess kurtosis of four values or more; 0 without spread."""
    return F.when(F.count(x) >= 4, F.when(F.stddev_pop(x) == 0, 0.0).otherwise(F.kurtosis(x)))


def entropy_of_counts(counts: Sequence[Column], alphabet: int | None = None) -> Column:
    """Entropy in bits of the counts over log2 of the alphabet; NULL if all are zero, 0 for an alphabet of one."""
    total = sum(counts[1:], counts[0])
    share = [c / F.nullif(total, F.lit(0)) for c in counts]
    bits = -sum((F.when(c > 0, p * F.log2(p)).otherwise(0.0) for c, p in zip(counts, share, strict=True)), F.lit(0.0))
    if alphabet is None:
        return F.when(total > 0, bits)
    return F.when(total > 0, bits / F.log2(F.lit(float(alphabet))) if alphabet > 1 else F.lit(0.0))


def entropy_of_array(counts: Column, alphabet: int) -> Column:
    """Entropy of an array of counts over log2 of the alphabet; small in generated code whatever the alphabet."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, c: s + c)
    bits = F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
    return F.when(total > 0, bits / F.log2(F.lit(float(alphabet))))


def normalized_entropy(count: Column, total: Column) -> Column:
    """Aggregate over a table of value counts: entropy over log2 of the number of values; 0 for one value."""
    p = count / total
    return F.when(F.count(count) > 1, -F.sum(p * F.log2(p)) / F.log2(F.count(count).cast("double"))).when(F.count(count) == 1, 0.0)


def duration_bin(seconds: Column) -> Column:
    made = F.lit(len(DURATION_ENDS))
    for k in range(len(DURATION_ENDS) - 1, -1, -1):
        made = F.when(seconds <= DURATION_ENDS[k], k).otherwise(made)
    return made


def duration_entropy(seconds: Column) -> Column:
    """Aggregate: normalised entropy over the seven duration bins."""
    return entropy_of_counts([F.count_if(F.when(seconds.isNotNull(), duration_bin(seconds) == k)) for k in range(7)], 7)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, NULL below two pairs or without spread; x and y must be null together."""
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def array_median(a: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def tolerant_clusters(values: Column, tolerance: float = 0.05) -> Column:
    """Clusters of a sorted array of doubles, in order: a value joins the open cluster if it lies within
    max(1, tolerance * |median|) of that cluster's median, else it opens the next one."""
    start = F.struct(F.array().cast("array<array<double>>").alias("closed"), F.array().cast("array<double>").alias("open"))

    def step(state: Column, v: Column) -> Column:
        middle = array_median(state["open"])
        near = (F.size(state["open"]) == 0) | (F.abs(v - middle) <= F.greatest(F.lit(1.0), tolerance * F.abs(middle)))
        return F.when(near, F.struct(state["closed"].alias("closed"), F.concat(state["open"], F.array(v)).alias("open"))).otherwise(
            F.struct(F.concat(state["closed"], F.array(state["open"])).alias("closed"), F.array(v).alias("open"))
        )

    return F.aggregate(values, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["closed"], F.array(s["open"]))).otherwise(s["closed"]))


def repeat_ratio_of_clusters(clusters: Column) -> Column:
    """Share of values in clusters of two or more."""
    n = F.aggregate(clusters, F.lit(0), lambda s, c: s + F.size(c))
    repeated = F.aggregate(clusters, F.lit(0), lambda s, c: s + F.when(F.size(c) >= 2, F.size(c)).otherwise(0))
    return repeated / F.nullif(n, F.lit(0))
