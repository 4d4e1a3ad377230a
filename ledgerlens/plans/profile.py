"""Profiles: the document of one wallet, and pages of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.rules import evaluate
from ledgerlens.plans.features import FAMILIES, feature_matrix

VERSIONS = {"feature_schema": "behaviour-features-2", "rules": "behaviour-rules-2", "observation": "30-days-1"}


def documents(features: DataFrame) -> DataFrame:
    """wallet and its profile as JSON: families with state and values, rules with evidence, versions."""
    parts = []
    for f in FAMILIES:
        own = [c for c in features.columns if c.startswith(f"{f}__") and c not in (f"{f}__support_state", "topology__n")]
        values = F.struct(*[F.col(c).alias(c.split("__")[1]) for c in own])
        parts.append(F.struct(F.coalesce(F.col(f"{f}__support_state"), F.lit("INSUFFICIENT_EVIDENCE")).alias("support_state"), values.alias("values")).alias(f))
    rules = evaluate(features).groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct("rule", "support_state", "score", "positive"))).alias("rules"))
    rows = features.join(rules, "wallet")
    return rows.select("wallet", F.to_json(F.struct(F.struct(*parts).alias("families"), F.col("rules"), F.struct(*[F.lit(v).alias(k) for k, v in VERSIONS.items()]).alias("versions"))).alias("profile"))


def profile(spark: SparkSession, sf_dir: str, wallet: int) -> DataFrame:
    """The profile of one wallet; the filter reaches the scans."""
    return documents(feature_matrix(spark, sf_dir, [wallet]))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of rows by wallet; sizes are held within 1 and 200."""
    size = min(200, max(1, size))
    return rows.orderBy("wallet").offset(max(0, number - 1) * size).limit(size)


#: Fields that a profile must not carry.
IDENTITY_FIELDS = ("label", "legacy_proxy_label", "classification", "identity", "prediction", "cluster")


def identity_keys(profiles: DataFrame) -> DataFrame:
    """wallet of profiles that name an identity field at any depth."""
    return profiles.filter(F.lower("profile").rlike('"(' + "|".join(IDENTITY_FIELDS) + ')"\\s*:')).select("wallet")
