"""The eleven evidence rules and MIXED, as arithmetic over the joined families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import RULE_FAMILIES
from ledgerlens.operators.support import combined


def or_one(c: str) -> Column:
    """The value, or 1 where it is missing or 0."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), 1.0).otherwise(F.col(c))


def join_families(families: dict[str, DataFrame]) -> DataFrame:
    """One row a wallet: family__support_state and family__value columns of every family."""
    renamed = [df.select("wallet", *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c != "wallet"]) for name, df in families.items()]
    return reduce(lambda a, b: a.join(b, "wallet", "full"), renamed)


def _conditions() -> dict[str, tuple[Column, list[Column]]]:
    c = F.col
    net = F.abs(c("capacity__target_net_capacity_delta")) / F.nullif(c("capacity__target_created_capacity") + c("capacity__target_consumed_capacity"), F.lit(0))
    cap = lambda x: F.least(F.lit(1.0), x)
    return {
        "PERIODIC_EXECUTION": (
            (c("periodicity__periodicity_strength") >= 0.80) & (c("periodicity__phase_stability") >= 0.75) & (c("temporal__interarrival_cv") <= 0.35),
            [c("periodicity__periodicity_strength"), c("periodicity__phase_stability"), 1 - cap(or_one("temporal__interarrival_cv"))],
        ),
        "BATCH_DISTRIBUTION": (
            (c("topology__one_to_many_ratio") >= 0.5) & (c("topology__external_output_lock_mean") >= 2) & (c("templates__template_repeat_ratio") >= 0.5),
            [c("topology__one_to_many_ratio"), cap(c("topology__external_output_lock_mean") / 2), c("templates__template_repeat_ratio")],
        ),
        "FAN_IN_COLLECTION": (
            (c("topology__many_to_one_ratio") >= 0.5) & (c("topology__external_input_lock_mean") >= 2) & (c("topology__topology_repeat_ratio") >= 0.5),
            [c("topology__many_to_one_ratio"), cap(c("topology__external_input_lock_mean") / 2), c("topology__topology_repeat_ratio")],
        ),
        "BURST_EXECUTION": (
            (c("temporal__burst_count") >= 2) & (c("temporal__transactions_in_bursts_ratio") >= 0.5),
            [cap(c("temporal__burst_count") / 2), c("temporal__transactions_in_bursts_ratio")],
        ),
        "CELL_FRAGMENTATION": (
            (c("topology__fragmentation_event_ratio") >= 0.3) & (c("topology__mean_fragmentation_factor") >= 2),
            [c("topology__fragmentation_event_ratio"), cap(c("topology__mean_fragmentation_factor") / 2)],
        ),
        "CELL_CONSOLIDATION": (
            (c("topology__consolidation_event_ratio") >= 0.3) & (c("topology__mean_consolidation_factor") >= 2),
            [c("topology__consolidation_event_ratio"), cap(c("topology__mean_consolidation_factor") / 2)],
        ),
        "SCRIPT_TEMPLATE_REPETITION": (
            (c("templates__template_repeat_ratio") >= 0.5) & (c("templates__dominant_template_ratio") >= 0.3),
            [c("templates__template_repeat_ratio"), c("templates__dominant_template_ratio")],
        ),
        "RAPID_CELL_TURNOVER": (c("lifecycle__rapid_consumption_ratio") >= 0.5, [c("lifecycle__rapid_consumption_ratio")]),
        "PASS_THROUGH_CANDIDATE": (
            (c("lifecycle__rapid_consumption_ratio") >= 0.5) & (c("lineage__continuation_ratio") >= 0.5) & (net <= 0.05),
            [c("lifecycle__rapid_consumption_ratio"), c("lineage__continuation_ratio"), 1 - cap(net)],
        ),
        "STATE_MACHINE_ACTIVITY": (
            (c("topology__n") >= 10) & (c("templates__dominant_template_count") <= 3) & (c("templates__dominant_template_coverage") >= 0.8)
            & (c("templates__transition_repeat_ratio") >= 0.6) & (or_one("templates__template_transition_entropy") <= 0.5),
            [c("templates__dominant_template_coverage"), c("templates__transition_repeat_ratio"), 1 - or_one("templates__template_transition_entropy")],
        ),
        "IRREGULAR_ACTIVITY": (
            (c("topology__n") >= 8) & (F.coalesce(c("periodicity__periodicity_strength"), F.lit(0.0)) < 0.3) & (c("temporal__gap_entropy") >= 0.7) & (F.coalesce(c("templates__template_repeat_ratio"), F.lit(0.0)) < 0.3),
            [1 - c("periodicity__periodicity_strength"), c("temporal__gap_entropy"), 1 - c("templates__template_repeat_ratio")],
        ),
    }


def evaluate(features: DataFrame) -> DataFrame:
    """wallet, rule, support_state, score, threshold_met, positive: twelve rows a wallet, MIXED last.

    features comes from join_families and also has topology__n, the number of transactions.
    """
    made = []
    for rule, (met, parts) in _conditions().items():
        state = combined([F.col(f"{f}__support_state") for f in RULE_FAMILIES[rule]])
        known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
        mean = sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0)) / F.nullif(known, F.lit(0))
        met = F.coalesce(met, F.lit(False))
        usable = state.isin("SUPPORTED", "PARTIAL")
        made.append(F.struct(F.lit(rule).alias("rule"), state.alias("support_state"), F.when(usable, mean).alias("score"), met.alias("threshold_met"), (met & usable).alias("positive")))
    wide = features.select("wallet", F.array(*made).alias("rules"))
    wide = wide.withColumn("k", F.size(F.filter("rules", lambda r: r["positive"])))
    mixed = F.struct(
        F.lit("MIXED").alias("rule"), F.when(F.col("k") >= 2, "SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE").alias("support_state"),
        F.when(F.col("k") > 0, F.least(F.lit(1.0), F.col("k") / 3)).alias("score"), (F.col("k") >= 2).alias("threshold_met"), (F.col("k") >= 2).alias("positive"),
    )
    return wide.select("wallet", F.explode(F.concat("rules", F.array(mixed))).alias("r")).select("wallet", "r.*")
