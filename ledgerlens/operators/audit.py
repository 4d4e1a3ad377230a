"""Audits over the feature matrix, wide (wallet and a double a feature) or long (wallet, feature, value): only statistics of
features and of pairs of them come to the driver, never a row a wallet."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import FORBIDDEN_TOKENS
from ledgerlens.functions import stats as S
from ledgerlens.operators import columns as K


def long_form(features: DataFrame, digits: int = 6) -> DataFrame:
    """wallet, feature, value of all numeric family__feature columns, nulls included; values rounded."""
    numeric = [f.name for f in features.schema if "__" in f.name and f.dataType.typeName() not in ("string", "boolean", "void")]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), digits).alias("value")) for c in numeric])
    return features.select("wallet", F.explode(cells).alias("f")).select("wallet", "f.*")


def learning_columns(features: DataFrame) -> list[str]:
    """Sorted numeric columns whose names hold none of the forbidden tokens."""
    numeric = [f.name for f in features.schema if "__" in f.name and f.dataType.typeName() not in ("string", "boolean", "void")]
    return sorted(c for c in numeric if not any(t in c.lower() for t in FORBIDDEN_TOKENS))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _impossible(feature: str) -> bool:
    """Whether a value of the feature must lie in 0 to 1."""
    return re.search("_(ratio|entropy|concentration|repetition|strength)$", feature) is not None and "autocorrelation" not in feature


def predictor_audit(matrix: DataFrame) -> DataFrame:
    """Per feature: counts, mode share, quantiles, outliers beyond 3 IQR, and its class by the precedence
    SUSPICIOUS, CONSTANT, NEAR_CONSTANT, VERY_SPARSE, SPARSE, USABLE."""
    wide = K.wide_form(matrix)
    names, total = K.names_of(wide), wide.count()
    q, mode = K.quantiles(wide, names, (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)), K.modes(wide, names)

    def far(low: float, high: float) -> Callable[[np.ndarray], np.ndarray]:
        iqr = high - low
        return lambda v: ((v < low - 3 * iqr) | (v > high + 3 * iqr)) & (iqr > 0)

    wrong = lambda v: (v < -1e-6) | (v > 1 + 1e-6)
    found = K.counts_where(wide, names, {f: [far(v[2], v[4]), *([wrong] if _impossible(f) else [])] for f, (_, v) in q.items()})
    rows = []
    for f in names:
        n, v = q.get(f, (0, [None] * 7))
        top, values = mode.get(f, (None, 0))
        outliers, impossible = (*found.get(f, [0]), 0)[:2]
        kind = "SUSPICIOUS" if impossible > 0 else "CONSTANT" if values <= 1 else "NEAR_CONSTANT" if top / n >= 0.99 else "VERY_SPARSE" if n / total < 0.2 else "SPARSE" if n / total < 0.5 else "USABLE"
        rows.append((f, total, n, total - n, values, top / n if n else None, v[0], v[6], *v[1:6], outliers, impossible, kind))
    return wide.sparkSession.createDataFrame(rows, "feature string, total long, n long, missing long, distinct_values long, mode_ratio double, low double, high double, p01 double, p25 double, p50 double, p75 double, p99 double, outliers long, impossible long, classification string")


def pair_correlations(matrix: DataFrame) -> DataFrame:
    """left, right, n, pearson, spearman of every pair of features over wallets that have both: columns meet in blocks, no
    pair of values is a row."""
    wide = K.wide_form(matrix)
    return K.correlations(wide, K.names_of(wide))


def _correlations(pairs: DataFrame) -> DataFrame:
    rank = lambda v: F.rank().over(Window.partitionBy("l", "r").orderBy(v)) + (F.count("*").over(Window.partitionBy("l", "r", v)) - 1) / 2
    ranked = pairs.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    return ranked.groupBy("l", "r").agg(F.count("*").alias("n"), S.pearson(F.col("x"), F.col("y")).alias("pearson"), S.pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def activity_leakage(matrix: DataFrame, activity: DataFrame) -> DataFrame:
    """Correlation of every feature with each activity metric (one row a wallet, one column a metric), thirty wallets or more."""
    wide = K.wide_form(matrix)
    names, metrics = K.names_of(wide), [c for c in activity.columns if c != "wallet"]
    found = K.correlations(wide.join(activity, "wallet"), names, metrics).filter("n >= 30")
    top = F.round(F.greatest(F.abs("pearson"), F.abs("spearman")), 6)
    return found.select(F.col("l").alias("feature"), F.col("r").alias("metric"), "n", "pearson", "spearman", F.when(top >= 0.8, "HIGH").when(top >= 0.5, "MODERATE").otherwise("LOW").alias("risk"))


def redundancy(pairs: DataFrame) -> DataFrame:
    """Pairs of |r| >= 0.90 over 50 wallets or more; KEEP_ONE from 0.95."""
    top = F.round(F.greatest(F.abs("pearson"), F.abs("spearman")), 6)
    return pairs.filter("n >= 50").withColumn("strength", top).filter("strength >= 0.9").select("l", "r", "n", "strength", F.when(top >= 0.95, "KEEP_ONE").otherwise("REVIEW").alias("advice"))


def redundancy_groups(strong: DataFrame) -> DataFrame:
    """feature, root: connected groups of features by KEEP_ONE pairs; as many nodes as features, so a driver loop."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for l, r in sorted((row["l"], row["r"]) for row in strong.filter("advice = 'KEEP_ONE'").select("l", "r").collect()):
        a, b = sorted((find(l), find(r)))
        root[b] = a
    rows = [(f, find(f)) for f in sorted(root)]
    return strong.sparkSession.createDataFrame(rows, "feature string, root string")


def missing_patterns(features: DataFrame, families: list[str]) -> DataFrame:
    """supported families of wallets as one pattern, with the number of wallets."""
    pattern = F.concat_ws("+", *[F.when(F.col(f"{f}__support_state") == "SUPPORTED", f) for f in families])
    return features.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("wallets"))


def cohorts(features: DataFrame, families: list[str], thresholds: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)) -> DataFrame:
    """threshold, wallets: wallets with at least so many supported families."""
    n = sum((F.when(F.col(f"{f}__support_state") == "SUPPORTED", 1).otherwise(0) for f in families), F.lit(0))
    counted = features.select(n.alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    return counted.select("k", "c", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("threshold").agg(F.sum(F.when(F.col("k") >= F.col("threshold"), F.col("c")).otherwise(0)).alias("wallets"))


def candidate_sets(audit: DataFrame, leakage: DataFrame, groups: DataFrame) -> DataFrame:
    """feature and membership in BROAD, CORE, LOW_REDUNDANCY and HIGH_CONFIDENCE."""
    leaks = leakage.groupBy("feature").agg(F.max(F.when(F.col("risk") == "HIGH", 2).when(F.col("risk") == "MODERATE", 1).otherwise(0)).alias("leak"))
    rows = audit.join(leaks, "feature", "left").join(groups, "feature", "left")
    broad = F.col("classification").isin("USABLE", "SPARSE") & (F.coalesce("leak", F.lit(0)) < 2)
    core = broad & (F.col("classification") == "USABLE")
    low = core & (F.col("root").isNull() | (F.col("root") == F.col("feature")))
    high = low & (F.coalesce("leak", F.lit(0)) == 0)
    return rows.select("feature", broad.alias("broad"), core.alias("core"), low.alias("low_redundancy"), high.alias("high_confidence"))


def distribution_issues(matrix: DataFrame, most: int = 5) -> DataFrame:
    """The most extreme wallets of each feature beyond 3 IQR: by distance from the median, then wallet.

    A wallet's far values are picked from its wide row, so that only these become rows.
    """
    wide = K.wide_form(matrix)
    made = []
    for f, (_, (low, mid, high)) in K.quantiles(wide, K.names_of(wide), (0.25, 0.5, 0.75)).items():
        iqr, v = high - low, F.col(f"`{f}`")
        if iqr > 0:
            far = (v < F.lit(low - 3 * iqr)) | (v > F.lit(high + 3 * iqr))
            made.append(F.when(far, F.struct(F.lit(f).alias("feature"), v.alias("value"), F.round(F.abs(v - F.lit(mid)), 6).alias("distance"))))
    if not made:
        return wide.sparkSession.createDataFrame([], "feature string, wallet long, value double, distance double, place int")
    far = wide.select("wallet", F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.feature", "wallet", "f.value", "f.distance")
    ranked = far.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("distance"), F.desc("wallet"))))
    return ranked.filter(F.col("place") <= most)


def family_contribution(features: DataFrame, families: list[str]) -> DataFrame:
    """family, wallets by support state and the share supported."""
    state = F.array(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.col(f"{f}__support_state"), F.lit("MISSING")).alias("state")) for f in families])
    s = F.col("s.state")
    return features.select(F.explode(state).alias("s")).groupBy(F.col("s.family").alias("family")).agg(
        F.count("*").alias("wallets"), F.count_if(s == "SUPPORTED").alias("supported"), F.count_if(s == "PARTIAL").alias("partial"),
        F.count_if(s.isin("INSUFFICIENT_EVIDENCE", "MISSING")).alias("insufficient"), (F.count_if(s == "SUPPORTED") / F.count("*")).alias("share"),
    )


def weekly_stability(tx: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(per wallet: weekly counts, variance, cv; per pair of adjacent weeks: wallets and Spearman of counts)."""
    week = tx.withColumn("week", F.expr(f"(ts - {start}) div 604800")).filter((F.col("ts") >= start) & (F.col("week") < 4))
    counts = week.groupBy("wallet", "week").agg(F.count("*").alias("n"))
    wallets = tx.select("wallet").distinct()
    grid = wallets.select("wallet", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("week")).join(counts, ["wallet", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = grid.groupBy("wallet").agg(F.sum("n").alias("total"), F.var_pop("n").alias("variance"), S.cv(F.col("n").cast("double")).alias("cv"), F.count_if(F.col("n") > 0).alias("active_weeks"))
    a, b = counts.select("wallet", F.col("week").alias("l"), F.col("n").alias("x")), counts.select("wallet", (F.col("week") - 1).alias("l"), F.col("n").alias("y"))
    pairs = a.join(b, ["wallet", "l"]).withColumn("r", F.col("l") + 1)
    adjacent = _correlations(pairs.select("l", "r", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).filter("n >= 10")
    return per, adjacent.select(F.col("l").alias("week"), F.col("r").alias("next_week"), "n", "spearman")


def readiness(features: DataFrame, families: list[str], shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75)) -> DataFrame:
    """share, ready, families, status: READY if all families reach the share of supported wallets, PARTIAL if any."""
    c = family_contribution(features, families).select("family", F.col("share").alias("s"))
    crossed = c.select("s", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    out = crossed.groupBy("share").agg(F.count_if(F.col("s") >= F.col("share")).alias("ready"), F.count("*").alias("families"))
    return out.withColumn("status", F.when(F.col("ready") == F.col("families"), "READY").when(F.col("ready") > 0, "PARTIAL").otherwise("NOT READY"))
