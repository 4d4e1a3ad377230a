"""Families and rules of the first version: five families, three rules and how far their cutoffs may move."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import stats as S
from ledgerlens.operators.cells import LOCK_FAMILIES, TYPE_FAMILIES
from ledgerlens.operators.support import gated
from ledgerlens.operators.temporal import gaps

#: Least number of transactions of each family, and of the periodicity values.
LEAST = {"temporal": 5, "topology": 3, "templates": 3, "scripts": 1, "capacity": 1}
LEAST_PERIODIC = 8
LEAST_GAPS = 4


def observation_support(n: Column, least: int, detail: Column | None = None, inputs: Column | None = None) -> Column:
    """INSUFFICIENT below the least number of transactions, PARTIAL where details or inputs are known to be incomplete."""
    state = F.when(F.coalesce(n, F.lit(0)) < least, "INSUFFICIENT_EVIDENCE")
    for complete in (detail, inputs):
        if complete is not None:
            state = state.when(~F.coalesce(complete, F.lit(True)), "PARTIAL")
    return state.otherwise("SUPPORTED")


def bits(count: Column, total: Column) -> Column:
    """Aggregate over a table of value counts: entropy in bits, not normalised."""
    p = count / total
    return -F.sum(p * F.log2(p))


def temporal(tx: DataFrame) -> DataFrame:
    """Twelve values; period, strength and phase only from eight transactions."""
    seen = gaps(tx)
    g = F.col("gap")
    base = seen.groupBy("wallet").agg(
        F.count("*").alias("n"), F.count(g).alias("g"), F.avg(g).alias("mean"), F.median(g).alias("median"), F.stddev_pop(g).alias("std"), S.cv(g).alias("cv"), F.min("ts").alias("t0"),
        F.array(*[F.count_if(F.expr(f"pmod(ts div 3600, 24) = {h}")) for h in range(24)]).alias("hours"), F.array(*[F.count_if(F.expr(f"pmod(ts div 86400 + 4, 7) = {d}")) for d in range(7)]).alias("days"),
    )
    turn = 2 * math.pi * F.pmod((F.col("ts") - F.col("t0")).cast("double"), F.col("median")) / F.col("median")
    near = F.abs(g - F.col("median")) <= F.greatest(F.lit(1.0), 0.05 * F.col("median"))
    spread = seen.join(base.select("wallet", "median", "t0"), "wallet").groupBy("wallet").agg(
        F.median(F.abs(g - F.col("median"))).alias("mad"), (F.count_if(near) / F.nullif(F.count(g), F.lit(0))).alias("repeat"),
        (F.sqrt(F.pow(F.sum(F.cos(turn)), F.lit(2.0)) + F.pow(F.sum(F.sin(turn)), F.lit(2.0))) / F.count("*")).alias("phase"),
    )
    rows = base.join(spread, "wallet", "left")
    periodic = lambda c: F.when((F.col("n") >= LEAST_PERIODIC) & (F.col("median") > 0), c)
    values = {
        "n_observed_transactions": F.col("n"), "interarrival_mean_seconds": F.col("mean"), "interarrival_median_seconds": F.col("median"), "interarrival_std_seconds": F.col("std"), "interarrival_cv": F.col("cv"),
        "burstiness": F.try_divide(F.col("std") - F.col("mean"), F.col("std") + F.col("mean")), "active_hour_entropy": S.entropy_of_array(F.col("hours"), 24), "active_weekday_entropy": S.entropy_of_array(F.col("days"), 7),
        "interval_repeat_ratio": F.col("repeat"), "dominant_period_seconds": periodic(F.col("median")), "periodicity_strength": periodic(F.exp(-F.col("mad") / F.nullif(F.col("median"), F.lit(0.0)))), "phase_stability": periodic(F.col("phase")),
    }
    state = F.when(F.col("g") < LEAST_GAPS, "INSUFFICIENT_EVIDENCE").otherwise(observation_support(F.col("n"), LEAST["temporal"]))
    return gated(rows, values, state)


def shapes(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells, locks and target cells of every transaction; external locks are those of a side that no target cell of it has."""
    side = lambda s: F.col("side") == s
    t = F.coalesce(F.col("target"), F.lit(False))
    counts = lambda f: [f(s, *k).alias(f"{s}_{k[0]}") for s in ("in", "out") for k in (("cells", F.lit(True)), ("target", t))]
    locks = cells.groupBy("wallet", "tx", "lock").agg(*counts(lambda s, _, c: F.count_if(side(s) & c)))
    known = F.col("lock").isNotNull()
    per = locks.groupBy("wallet", "tx").agg(
        *counts(lambda s, name, _: F.sum(f"{s}_{name}")), *[F.count_if(known & (F.col(f"{s}_cells") > 0)).alias(f"{s}_lock_count") for s in ("in", "out")],
        *[F.count_if(known & (F.col(f"{s}_cells") > 0) & (F.col(f"{s}_target") == 0)).alias(f"{s}_external") for s in ("in", "out")],
    )
    names = [f"{s}_{k}" for s in ("in", "out") for k in ("cells", "target", "lock_count", "external")]
    return tx.select("wallet", "tx", "ts", "idx").join(per, ["wallet", "tx"], "left").select("wallet", "tx", "ts", "idx", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in names])


def topology(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """Thirteen values over transactions; a signature has cells and locks of both sides and whether the target is on them."""
    per = shapes(tx, cells)
    sides = ["in_cells", "out_cells", "in_lock_count", "out_lock_count"]
    counted = per.groupBy("wallet", *sides, (F.col("in_target") > 0).alias("a"), (F.col("out_target") > 0).alias("b")).agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("wallet")))
    signature = counted.groupBy("wallet").agg(S.normalized_entropy(F.col("c"), F.col("t")).alias("entropy"), (F.max("c") / F.sum("c")).alias("top"))
    i, o = F.col("in_cells"), F.col("out_cells")
    share = lambda c: F.count_if(c) / F.count("*")
    spends, gets, many_in, many_out = F.col("in_target") > 0, F.col("out_target") > 0, F.col("in_lock_count") > 1, F.col("out_lock_count") > 1
    values = {
        "mean_input_cells_per_tx": F.avg(i), "mean_output_cells_per_tx": F.avg(o), "max_input_cells_per_tx": F.max(i), "max_output_cells_per_tx": F.max(o), "fanin_transaction_ratio": share(gets & many_in),
        "fanout_transaction_ratio": share(spends & many_out), "many_to_many_ratio": share(many_in & many_out), "cell_fragmentation_ratio": share(spends & (o > i)), "cell_consolidation_ratio": share(gets & (i > o)),
        "mean_external_input_locks": F.avg("in_external"), "mean_external_output_locks": F.avg("out_external"),
    }
    rows = per.groupBy("wallet").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in values.items()]).join(signature, "wallet")
    kept = {k: F.col(k) for k in values} | {"topology_entropy": F.col("entropy"), "topology_repeat_ratio": F.col("top")}
    return gated(rows, kept, observation_support(F.col("n"), LEAST["topology"]))


def _family_or_id(value: Column, key: Column, known: dict) -> Column:
    """The registered family of a script, else its own id, else UNKNOWN."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)
    return F.coalesce(named, value.cast("string"), F.lit("UNKNOWN"))


def template_hashes(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """wallet, tx, ts, idx, template: cell counts, target sides, scripts and data of every cell, capacity shares to two places."""
    lock = _family_or_id(F.col("lock"), F.pmod(F.col("lock"), F.lit(5)).cast("int"), LOCK_FAMILIES)
    kind = _family_or_id(F.col("type"), F.col("type"), TYPE_FAMILIES)
    one = F.concat_ws(":", F.col("side"), lock, kind, F.when(F.col("asset").isNotNull(), "16").otherwise("0"))
    side, t = lambda s: F.col("side") == s, F.coalesce(F.col("target"), F.lit(False))
    listed = cells.groupBy("wallet", "tx").agg(
        *[F.count_if(side(s)).alias(f"{s}_cells") for s in ("in", "out")], *[F.count_if(side(s) & t).alias(f"{s}_target") for s in ("in", "out")],
        *[F.nullif(F.sum(F.when(side(s), F.col("capacity"))), F.lit(0)).alias(f"{s}_total") for s in ("in", "out")], *[F.collect_list(F.when(side(s), F.col("capacity"))).alias(f"{s}_capacities") for s in ("in", "out")],
        F.array_join(F.sort_array(F.collect_list(one)), ",").alias("ones"),
    )
    whole = lambda s: F.when(F.size(f"{s}_capacities") == F.col(f"{s}_cells"), F.col(f"{s}_total"))
    share = lambda s: F.transform(F.col(f"{s}_capacities"), lambda c: F.concat(F.lit(f"{s}="), F.bround(F.try_divide(100 * c, whole(s)), 0).cast("int")))
    listed = listed.withColumn("shares", F.array_join(F.sort_array(F.concat(share("in"), share("out"))), ","))
    per = tx.select("wallet", "tx", "ts", "idx").join(listed, ["wallet", "tx"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    text = F.concat_ws("|", zero("in_cells"), zero("out_cells"), zero("in_target") > 0, zero("out_target") > 0, F.coalesce("ones", F.lit("")), F.coalesce("shares", F.lit("")))
    return per.select("wallet", "tx", "ts", "idx", F.sha2(text, 256).alias("template"))


def templates(hashes: DataFrame) -> DataFrame:
    """Five values over template hashes; entropies are in bits and not normalised."""
    along = Window.partitionBy("wallet").orderBy("ts", "idx", "tx")
    counted = hashes.groupBy("wallet", "template").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("wallet")))
    agg = counted.groupBy("wallet").agg(F.max("t").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("top"), bits(F.col("c"), F.col("t")).alias("entropy"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("again"))
    pairs = hashes.select("wallet", "template", F.lead("template").over(along).alias("after")).filter("after is not null")
    steps = pairs.groupBy("wallet", "template", "after").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("wallet"))).groupBy("wallet").agg(bits(F.col("c"), F.col("t")).alias("steps"))
    n = F.col("n")
    values = {
        "unique_template_count": F.col("kinds"), "dominant_template_ratio": F.col("top") / n, "template_entropy": F.col("entropy"), "template_repeat_ratio": F.col("again") / n,
        "template_transition_entropy": F.coalesce("steps", F.lit(0.0)),
    }
    return gated(agg.join(steps, "wallet", "left"), values, observation_support(n, LEAST["templates"]))


def scripts(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of every script family as text, cells with a script, all cells and their ratio; PARTIAL without scripts."""
    named = lambda c, key, known: F.when(F.col(c).isNotNull(), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key), F.lit("UNKNOWN")))
    both = cells.select("wallet", F.explode(F.array(named("lock", F.pmod(F.col("lock"), F.lit(5)).cast("int"), LOCK_FAMILIES), named("type", F.col("type"), TYPE_FAMILIES))).alias("family")).filter("family is not null")
    counted = both.groupBy("wallet", "family").agg(F.count("*").alias("c"))
    told = counted.groupBy("wallet").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "family", F.col("c").cast("string")))), ",").alias("told"), F.sum("c").alias("known"))
    rows = tx.groupBy("wallet").agg(F.count("*").alias("n")).join(cells.groupBy("wallet").agg(F.count("*").alias("cells")), "wallet", "left").join(told, "wallet", "left")
    known, every = F.coalesce("known", F.lit(0)), F.coalesce("cells", F.lit(0))
    values = {"script_family_counts": F.coalesce("told", F.lit("")), "cells_with_full_script_count": known, "total_cell_count": every, "full_script_coverage_ratio": F.try_divide(known, F.nullif(every, F.lit(0)))}
    return gated(rows, values, F.when(known == 0, "PARTIAL").otherwise(observation_support(F.col("n"), LEAST["scripts"])))


def capacity(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """Six values over target capacities by transaction; transactions with an unknown one are left out and make it PARTIAL."""
    mine = F.coalesce(F.col("target"), F.lit(False))
    total = lambda s: F.coalesce(F.sum(F.when(mine & (F.col("side") == s), F.col("capacity").cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))
    per = cells.groupBy("wallet", "tx").agg(total("in").alias("i"), total("out").alias("o"), F.coalesce(F.bool_and(F.when(mine, F.col("capacity").isNotNull())), F.lit(True)).alias("known"))
    rows = tx.select("wallet", "tx").join(per, ["wallet", "tx"], "left").select("wallet", F.coalesce("known", F.lit(True)).alias("known"), *[F.coalesce(c, F.lit(0).cast("decimal(38,0)")).alias(c) for c in ("i", "o")])
    use = lambda c: F.when(F.col("known"), c)
    delta = F.col("o") - F.col("i")
    agg = rows.groupBy("wallet").agg(
        F.count("*").alias("n"), F.bool_and("known").alias("complete"), F.sum(use(F.col("i"))).alias("si"), F.sum(use(F.col("o"))).alias("so"), F.sum(use(delta)).alias("sd"),
        F.avg(use(F.col("i")).cast("double")).alias("mi"), F.avg(use(F.col("o")).cast("double")).alias("mo"), F.median(use(F.abs(delta)).cast("double")).alias("md"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    values = {
        "target_input_capacity": zero("si"), "target_output_capacity": zero("so"), "target_net_capacity_delta": zero("sd"), "mean_target_input_capacity": F.col("mi"), "mean_target_output_capacity": F.col("mo"),
        "median_abs_target_delta": F.col("md"),
    }
    return gated(agg, values, observation_support(F.col("n"), LEAST["capacity"], inputs=F.col("complete")))


#: The checks of the three rules, each (family, feature, direction, cutoff, reason).
RULES = {
    "PERIODIC_EXECUTION": (
        ("temporal", "periodicity_strength", 1, 0.80, "STRONG_PERIODICITY"), ("temporal", "phase_stability", 1, 0.75, "STABLE_PHASE"), ("temporal", "interarrival_cv", -1, 0.35, "LOW_INTERVAL_VARIABILITY"),
    ),
    "BATCH_DISTRIBUTION": (
        ("topology", "fanout_transaction_ratio", 1, 0.50, "REPEATED_FAN_OUT_STRUCTURE"), ("topology", "mean_external_output_locks", 1, 2.0, "MANY_EXTERNAL_OUTPUT_LOCKS"), ("templates", "template_repeat_ratio", 1, 0.50, "REPEATED_TRANSACTION_TEMPLATE"),
    ),
    "FAN_IN_COLLECTION": (
        ("topology", "fanin_transaction_ratio", 1, 0.50, "REPEATED_FAN_IN_STRUCTURE"), ("topology", "mean_external_input_locks", 1, 2.0, "MANY_EXTERNAL_INPUT_LOCKS"), ("topology", "topology_repeat_ratio", 1, 0.50, "REPEATED_TOPOLOGY"),
    ),
}


def _passes(value: Column, way: int, cutoff: Column | float) -> Column:
    return F.coalesce(value >= cutoff if way > 0 else value <= cutoff, F.lit(False))


def evaluate(features: DataFrame) -> DataFrame:
    """wallet, rule, support_state, score, reasons and supported of a matrix of family__value columns.

    score is the share of passed checks, NULL without evidence of the first family; a full score has the state of the
    families, any other score is PARTIAL.
    """
    made = []
    for rule, checks in RULES.items():
        first = checks[0][0]
        passed = [_passes(F.col(f"{f}__{v}"), way, cut) for f, v, way, cut, _ in checks]
        score = sum((p.cast("int") for p in passed), F.lit(0)) / len(checks)
        missing = F.coalesce(F.col(f"{first}__support_state"), F.lit("INSUFFICIENT_EVIDENCE")) == "INSUFFICIENT_EVIDENCE"
        if rule == "PERIODIC_EXECUTION":
            missing = missing | F.col("temporal__periodicity_strength").isNull()
        families = dict.fromkeys(["topology", "templates"] if first == "topology" else [first])
        full = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{f}__support_state") == "SUPPORTED", F.lit(False)) for f in families])
        state = F.when(missing, "INSUFFICIENT_EVIDENCE").when((score == 1) & full, "SUPPORTED").otherwise("PARTIAL")
        reasons = F.concat_ws(",", *[F.when(p, reason) for p, (*_, reason) in zip(passed, checks, strict=True)])
        reasons = F.when(missing, f"INSUFFICIENT_{first.upper()}_SUPPORT").otherwise(reasons)
        made.append(F.struct(F.lit(rule).alias("rule"), state.alias("support_state"), F.when(~missing, score).alias("score"), reasons.alias("reasons"), (state == "SUPPORTED").alias("supported")))
    return features.select("wallet", F.explode(F.array(*made)).alias("r")).select("wallet", "r.*")


def sensitivity(features: DataFrame, factors: tuple[float, ...] = (0.8, 1.0, 1.2)) -> DataFrame:
    """wallet, rule, metric, decisions under each factor, verdict.

    metric ALL moves all cutoffs of the rule at once; every other row moves one cutoff.  A cutoff is stable if its
    decisions agree; a rule is stable if each of its cutoffs is.
    """
    made = []
    for rule, checks in RULES.items():
        value = {v: F.col(f"{f}__{v}") for f, v, *_ in checks}

        def decide(moved: set[str], factor: float, checks=checks, value=value) -> Column:
            return reduce(lambda a, b: a & b, [_passes(value[v], way, cut * (factor if v in moved else 1.0)) for _, v, way, cut, _ in checks])

        def same(moved: set[str], decide=decide) -> Column:
            return reduce(lambda a, b: a & b, [decide(moved, factors[0]) == decide(moved, f) for f in factors[1:]])

        each = [same({v}) for v in value]
        told = lambda ok: F.when(ok, "stable").otherwise("threshold-sensitive")
        rows = [("ALL", set(value), reduce(lambda a, b: a & b, each))] + [(v, {v}, ok) for v, ok in zip(value, each, strict=True)]
        for metric, moved, ok in rows:
            decisions = [decide(moved, f).alias(name) for f, name in zip(factors, ("at_low", "at_base", "at_high"), strict=True)]
            made.append(F.struct(F.lit(rule).alias("rule"), F.lit(metric).alias("metric"), *decisions, told(ok).alias("verdict")))
    return features.select("wallet", F.explode(F.array(*made)).alias("r")).select("wallet", "r.*")
