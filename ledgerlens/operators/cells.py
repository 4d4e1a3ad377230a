"""Families over flat cell rows: topology, capacity, scripts, typed assets, lifecycle, lineage and templates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import LONG, RAPID, SHORT, TOLERANCE
from ledgerlens.functions import stats as S
from ledgerlens.operators.support import gated, support_state

TOPOLOGIES = ("1_TO_1", "1_TO_N", "N_TO_1", "N_TO_N", "OTHER")
#: Registry of script families: lock modulo five and type to a family; all others are UNKNOWN.
LOCK_FAMILIES = {0: "F0", 1: "F1", 2: "F2", 3: "F3"}
TYPE_FAMILIES = {"A": "TA", "R": "TR"}


def _in_order() -> Window:
    return Window.partitionBy("wallet").orderBy("ts", "idx", "tx")


def topology_of(i: Column, o: Column) -> Column:
    """Class of a transaction by its numbers of inputs and outputs."""
    return F.when((i == 1) & (o == 1), "1_TO_1").when((i == 1) & (o > 1), "1_TO_N").when((i > 1) & (o == 1), "N_TO_1").when((i > 1) & (o > 1), "N_TO_N").otherwise("OTHER")


def shapes(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each transaction: cell counts, target counts, external locks and topology class.

    Cells are counted by lock first, so that no list of locks is made; a lock is external if no target cell has it.
    """
    side = lambda s: F.col("side") == s
    t = F.coalesce(F.col("target"), F.lit(False))
    locks = cells.groupBy("wallet", "tx", "lock").agg(F.count_if(side("in")).alias("i"), F.count_if(side("out")).alias("o"), F.count_if(side("in") & t).alias("ti"), F.count_if(side("out") & t).alias("to"))
    away = lambda c: F.count_if(F.col("lock").isNotNull() & (F.col("ti") + F.col("to") == 0) & (F.col(c) > 0))
    per = locks.groupBy("wallet", "tx").agg(away("i").alias("external_in"), away("o").alias("external_out"), *[F.sum(c).alias(c) for c in ("i", "o", "ti", "to")])
    rows = tx.select("wallet", "tx", "ts", "idx").join(per, ["wallet", "tx"], "left")
    for c in ("i", "o", "ti", "to", "external_in", "external_out"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    return rows.select("wallet", "tx", "ts", "idx", "i", "o", "ti", "to", topology_of(F.col("i"), F.col("o")).alias("topology"), "external_in", "external_out")


def transitions(rows: DataFrame, value: str) -> DataFrame:
    """wallet, transition_entropy, transition_repeat_ratio, consecutive_repeat_ratio of a sequence of values."""
    pairs = rows.select("wallet", F.col(value).alias("a"), F.lead(F.struct(F.col(value).alias("v"))).over(_in_order()).alias("next")).filter("next is not null").select("wallet", "a", F.col("next.v").alias("b"))
    counted = pairs.groupBy("wallet", "a", "b").agg(F.count("*").alias("c")).withColumn("total", F.sum("c").over(Window.partitionBy("wallet")))
    return counted.groupBy("wallet").agg(
        S.normalized_entropy(F.col("c"), F.col("total")).alias("transition_entropy"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("transition_repeat_ratio"),
        (F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.sum("c")).alias("consecutive_repeat_ratio"),
    )


def topology_features(tx: DataFrame, cells: DataFrame) -> DataFrame:
    per = shapes(tx, cells)
    frag, cons = (F.col("ti") > 0) & (F.col("to") > F.col("ti")), (F.col("to") > 0) & (F.col("ti") > F.col("to"))
    first = F.min(F.struct("ts", "idx", "tx"))
    dominant = per.groupBy("wallet", "topology").agg(F.count("*").alias("c"), first.alias("seen")).groupBy("wallet").agg(F.min_by("topology", F.struct(-F.col("c"), F.col("seen"))).alias("dominant"))
    n = F.count("*")
    agg = per.groupBy("wallet").agg(
        n.alias("n"), *[(F.count_if(F.col("topology") == t) / n).alias(t) for t in TOPOLOGIES],
        F.avg("i").alias("im"), F.median("i").alias("id"), S.cv(F.col("i")).alias("ic"), F.avg("o").alias("om"), F.median("o").alias("od"), S.cv(F.col("o")).alias("oc"),
        F.avg("external_in").alias("ei"), F.avg("external_out").alias("eo"),
        _entropy_of_kinds([F.count_if(F.col("topology") == t) for t in TOPOLOGIES]).alias("entropy"),
        F.count_if(frag).alias("fn"), F.avg(F.when(frag, F.col("to") / F.col("ti"))).alias("fm"), F.max(F.when(frag, F.col("to") / F.col("ti"))).alias("fx"),
        F.count_if(cons).alias("cn"), F.avg(F.when(cons, F.col("ti") / F.col("to"))).alias("cm"), F.max(F.when(cons, F.col("ti") / F.col("to"))).alias("cx"),
    )
    rows = agg.join(dominant, "wallet").join(transitions(per, "topology"), "wallet", "left")
    top = F.greatest(*[F.col(t) for t in TOPOLOGIES])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    values = {
        "one_to_one_ratio": F.col("1_TO_1"), "one_to_many_ratio": F.col("1_TO_N"), "many_to_one_ratio": F.col("N_TO_1"), "many_to_many_ratio": F.col("N_TO_N"), "other_ratio": F.col("OTHER"),
        "dominant_topology": F.col("dominant"), "dominant_topology_ratio": top, "input_cell_count_mean": F.col("im"), "input_cell_count_median": F.col("id"), "input_cell_count_cv": F.col("ic"),
        "output_cell_count_mean": F.col("om"), "output_cell_count_median": F.col("od"), "output_cell_count_cv": F.col("oc"), "external_input_lock_mean": F.col("ei"), "external_output_lock_mean": F.col("eo"),
        "topology_entropy": F.col("entropy"), "topology_repeat_ratio": top, "topology_transition_entropy": F.col("transition_entropy"),
        "fragmentation_event_count": F.col("fn"), "fragmentation_event_ratio": F.col("fn") / F.col("n"), "mean_fragmentation_factor": zero("fm"), "max_fragmentation_factor": zero("fx"),
        "consolidation_event_count": F.col("cn"), "consolidation_event_ratio": F.col("cn") / F.col("n"), "mean_consolidation_factor": zero("cm"), "max_consolidation_factor": zero("cx"),
    }
    return gated(rows, values, support_state("topology", F.col("n")))


def _entropy_of_kinds(counts: list[Column]) -> Column:
    """Entropy over log2 of the number of kinds that occur; 0 for one kind, NULL for none."""
    kinds = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    bits = S.entropy_of_counts(counts)
    return F.when(kinds > 1, bits / F.log2(kinds.cast("double"))).when(kinds == 1, 0.0)


def capacity_features(cells: DataFrame) -> DataFrame:
    mine = cells.filter("target")
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    counted = mine.groupBy("wallet", "capacity").agg(F.count("*").alias("c")).groupBy("wallet").agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat"))
    by_side = mine.groupBy("wallet", "side", "capacity").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("wallet", "side")))
    entropy = by_side.groupBy("wallet").agg(*[S.normalized_entropy(F.when(F.col("side") == s, F.col("c")), F.col("t")).alias(f"{s}_entropy") for s in ("in", "out")])
    agg = mine.groupBy("wallet").agg(
        F.count("*").alias("n"), *[f(side(s, "capacity")).alias(f"{s}_{k}") for s in ("in", "out") for k, f in (("mean", F.avg), ("median", F.median), ("cv", S.cv))],
        F.coalesce(big(side("out", "capacity")), F.lit(0)).alias("created"), F.coalesce(big(side("in", "capacity")), F.lit(0)).alias("consumed"),
        big(F.col("occupied")).alias("occupied"), big(F.col("capacity")).alias("every"),
        F.bool_and(F.col("occupied").isNotNull() & ((F.col("side") == "in") | (F.col("occupied") <= F.col("capacity")))).alias("complete"),
    )
    rows = agg.join(counted, "wallet").join(entropy, "wallet")
    values = {
        **{f"{'input' if s == 'in' else 'output'}_capacity_{k}": F.col(f"{s}_{k}") for s in ("in", "out") for k in ("mean", "median", "cv")},
        "capacity_repeat_ratio": F.col("repeat"), "capacity_input_entropy": F.col("in_entropy"), "capacity_output_entropy": F.col("out_entropy"),
        "target_created_capacity": F.col("created").cast("bigint"), "target_consumed_capacity": F.col("consumed").cast("bigint"), "target_net_capacity_delta": (F.col("created") - F.col("consumed")).cast("bigint"),
        "occupied_capacity_total": F.col("occupied").cast("bigint"), "excess_capacity_total": (F.col("every") - F.col("occupied")).cast("bigint"),
    }
    return gated(rows, values, support_state("capacity", F.col("n"), complete=F.col("complete")))


def _family(value: Column, known: dict) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), value), F.lit("UNKNOWN"))


def _script_codes() -> Column:
    """A byte for the lock and type families of a cell, in the order of their names."""
    rank = lambda known: {k: i for i, k in enumerate(sorted({*known.values(), "UNKNOWN"}))}
    code = lambda c, known: F.element_at(F.create_map(*[F.lit(x) for kv in rank(known).items() for x in kv]), F.col(c))
    return (16 * code("lf", LOCK_FAMILIES) + code("tf", TYPE_FAMILIES)).cast("bigint")


def script_features(cells: DataFrame) -> DataFrame:
    """Families are counted in one pass by wallet; only distinct scripts are groups of their own."""
    named = cells.withColumn("lf", _family(F.pmod(F.col("lock"), F.lit(5)).cast("int"), LOCK_FAMILIES)).withColumn("tf", _family(F.col("type"), TYPE_FAMILIES))
    kinds = {"lock": ("lf", sorted({*LOCK_FAMILIES.values(), "UNKNOWN"})), "type": ("tf", sorted({*TYPE_FAMILIES.values(), "UNKNOWN"}))}
    count = lambda p, f: F.count_if(F.col(p).isNotNull() & (F.col(kinds[p][0]) == f)).alias(f"{p}_{f}")
    agg = named.groupBy("wallet").agg(F.count("*").alias("n"), (F.count("lock") + F.count("type")).alias("slots"), *[count(p, f) for p, (_, families) in kinds.items() for f in families])
    unique = lambda p: cells.select("wallet", p).distinct().groupBy("wallet").agg(F.count(p).alias(f"u_{p}"))
    place = F.when(F.col("side") == "in", 0).otherwise(1).cast("bigint") * (1 << 48) + (F.coalesce("pos", F.lit(-1)).cast("bigint") + 1) * 256
    token = F.transform(F.sort_array(F.collect_list(place + _script_codes())), lambda x: x.bitwiseAND(F.lit(255).cast("bigint")))
    per_tx = named.groupBy("wallet", "tx").agg(F.min("ts").alias("ts"), F.min("idx").alias("idx"), token.alias("token"))
    rows = agg.join(unique("lock"), "wallet").join(unique("type"), "wallet").join(transitions(per_tx, "token").select("wallet", "transition_entropy"), "wallet", "left")

    def of(p: str) -> dict[str, Column]:
        counts = {f: F.col(f"{p}_{f}") for f in kinds[p][1]}
        total = F.nullif(sum(counts.values(), F.lit(0)), F.lit(0))
        known = sum((F.when(c > 0, 1).otherwise(0) for f, c in counts.items() if f != "UNKNOWN"), F.lit(0))
        return {"count": F.when(total.isNotNull(), known), "entropy": _entropy_of_kinds(list(counts.values())), "dominant": F.greatest(*counts.values()) / total, "unknown": counts["UNKNOWN"] / total}

    lock, kind = of("lock"), of("type")
    values = {
        "unique_lock_script_count": F.col("u_lock"), "unique_type_script_count": F.col("u_type"), "lock_family_count": lock["count"], "type_family_count": kind["count"],
        "lock_family_entropy": lock["entropy"], "type_family_entropy": kind["entropy"], "dominant_lock_family_ratio": lock["dominant"],
        "dominant_type_family_ratio": kind["dominant"], "unknown_lock_ratio": lock["unknown"], "unknown_type_ratio": kind["unknown"],
        "script_repeat_ratio": 1 - (F.col("u_lock") + F.col("u_type")) / F.col("slots"), "script_transition_entropy": F.col("transition_entropy"), "script_coverage": F.col("slots") / (2 * F.col("n")),
    }
    return gated(rows.filter(lock["count"].isNotNull()), values, support_state("scripts", F.col("n"), complete=F.col("slots") == 2 * F.col("n")))


def typed_asset_features(cells: DataFrame) -> DataFrame:
    """Amounts of typed cells; below three decoded cells the state is PARTIAL with all values NULL, or INSUFFICIENT."""
    typed = F.col("asset").isNotNull()
    a = F.col("asset").cast("decimal(38,0)")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, a)), F.lit(0))
    counted = cells.filter(typed).groupBy("wallet", "asset").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("wallet")))
    repeated = counted.groupBy("wallet").agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat"), S.normalized_entropy(F.col("c"), F.col("t")).alias("entropy"))
    per = cells.filter(typed).groupBy("wallet", "tx").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    fan = per.groupBy("wallet").agg((F.count_if(F.col("o") > F.col("i")) / F.count("*")).alias("fanout"), (F.count_if(F.col("i") > F.col("o")) / F.count("*")).alias("fanin"))
    agg = cells.groupBy("wallet").agg(F.count("*").alias("n"), F.count_if(typed).alias("k"), F.count_distinct(F.when(typed, F.col("type"))).alias("kinds"), side("in").alias("si"), side("out").alias("so"))
    rows = agg.join(repeated, "wallet", "left").join(fan, "wallet", "left")
    state = F.when(F.col("k") >= 3, "SUPPORTED").when(F.col("k") > 0, "PARTIAL").otherwise("INSUFFICIENT_EVIDENCE")
    full = lambda v: F.when(F.col("k") >= 3, v)
    values = {
        "typed_asset_count": F.col("k"), "asset_diversity": F.col("kinds"), "typed_cell_ratio": F.col("k") / F.col("n"), "token_input_total": F.col("si").cast("bigint"), "token_output_total": F.col("so").cast("bigint"),
        "net_token_delta": (F.col("so") - F.col("si")).cast("bigint"), "token_turnover": (F.col("so") + F.col("si")).cast("bigint"), "repeated_token_amount_ratio": F.col("repeat"),
        "token_amount_entropy": F.col("entropy"), "token_fanout_ratio": F.col("fanout"), "token_fanin_ratio": F.col("fanin"),
    }
    return gated(rows, {k: full(v) for k, v in values.items()}, state)


def lifetimes(cells: DataFrame) -> DataFrame:
    """Target cells that the wallet spent: seconds from the creating to the spending transaction."""
    spent = cells.filter("side = 'in' and target and prev_tx is not null and prev_pos is not null and prev_ts is not null")
    return spent.select("wallet", "tx", "prev_tx", "prev_pos", (F.col("ts") - F.col("prev_ts")).alias("seconds"), ((F.col("ts") - F.col("prev_ts")) / 86400).cast("bigint").alias("blocks")).filter("seconds >= 0")


def right_censored(cells: DataFrame) -> DataFrame:
    """Target outputs that no input of the wallet spends."""
    made = cells.filter("side = 'out' and target").select("wallet", "tx", "pos")
    spent = cells.filter("side = 'in' and target").select("wallet", F.col("prev_tx").alias("tx"), F.col("prev_pos").alias("pos"))
    return made.join(spent, ["wallet", "tx", "pos"], "left_anti")


def lifecycle_features(cells: DataFrame) -> DataFrame:
    s = F.col("seconds")
    life = lifetimes(cells).groupBy("wallet").agg(
        F.count("*").alias("k"), F.avg(s).alias("mean"), F.percentile(s, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)])).alias("q"), F.stddev_pop(s).alias("std"), S.cv(s).alias("cv"),
        F.avg("blocks").alias("bm"), F.median("blocks").alias("bd"), *[(F.count_if(c) / F.count("*")).alias(n) for n, c in (("short", s <= SHORT), ("long", s >= LONG), ("rapid", s <= RAPID), ("same", F.col("blocks") == 0))],
        S.duration_entropy(s).alias("entropy"), S.repeat_ratio_of_clusters(S.tolerant_clusters(F.sort_array(F.collect_list(s.cast("double"))), TOLERANCE)).alias("repeat"),
    )
    seen = cells.filter("side = 'out' and target").groupBy("wallet").agg(F.count("*").alias("observed"))
    open_ = right_censored(cells).groupBy("wallet").agg(F.count("*").alias("censored"))
    rows = seen.join(life, "wallet", "full").join(open_, "wallet", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = {
        "observed_cell_count": zero("observed"), "consumed_cell_count": F.col("k"), "right_censored_cell_count": zero("censored"), "mean_lifetime_seconds": F.col("mean"), "median_lifetime_seconds": F.col("q")[1],
        "lifetime_std": F.col("std"), "lifetime_cv": F.col("cv"), "lifetime_p25": F.col("q")[0], "lifetime_p75": F.col("q")[2], "lifetime_p90": F.col("q")[3], "mean_lifetime_blocks": F.col("bm"), "median_lifetime_blocks": F.col("bd"),
        "short_lived_ratio": F.col("short"), "long_lived_ratio": F.col("long"), "rapid_consumption_ratio": F.col("rapid"), "same_block_ratio": F.col("same"), "lifetime_entropy": F.col("entropy"), "lifetime_repeat_ratio": F.col("repeat"),
    }
    return gated(rows, values, support_state("lifecycle", F.col("k")))


def continuations(cells: DataFrame) -> DataFrame:
    """Transactions with a (type, lock) pair on both target sides; a missing type equals a missing type."""
    side = lambda s: F.col("side") == s
    t = F.coalesce(F.col("target"), F.lit(False))
    pairs = cells.groupBy("wallet", "tx", "type", "lock").agg(
        F.bool_or(side("in") & t).alias("a"), F.bool_or(side("out") & t).alias("b"), F.min("ts").alias("ts"), F.min("idx").alias("idx"), F.count_if(side("in")).alias("i"), F.count_if(side("out")).alias("o")
    )
    per = pairs.groupBy("wallet", "tx").agg(F.min("ts").alias("ts"), F.min("idx").alias("idx"), F.sum("i").alias("i"), F.sum("o").alias("o"), F.bool_or(F.col("a") & F.col("b")).alias("continues"))
    return per.select("wallet", "tx", "ts", "idx", "i", "o", "continues")


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth of each wallet from its transactions, which come one after the other in time: one fold over the rows."""
    wallet, depth = None, {}
    for batch in batches:
        done: list[tuple] = []
        for own, tx, has_input, parents in zip(*(batch.column(c).to_pylist() for c in ("wallet", "tx", "has_input", "parents")), strict=True):
            if own != wallet:
                if depth:
                    done.append((wallet, max(depth.values())))
                wallet, depth = own, {}
            depth[tx] = int(has_input) + max((depth.get(p, 0) for p in parents), default=0)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in done], pa.int64()), pa.array([d for _, d in done], pa.int64())], ["wallet", "depth"])
    if depth:
        yield pa.RecordBatch.from_arrays([pa.array([wallet], pa.int64()), pa.array([max(depth.values())], pa.int64())], ["wallet", "depth"])


def lineage_depth(cells: DataFrame) -> DataFrame:
    """wallet, depth: transactions on the longest chain of in-wallet spends.

    A parent is a transaction of the wallet whose output cell is spent; rows stream through one fold in the order of
    time, which holds a number for each transaction of the wallet at hand, never its cells.
    """
    made = cells.filter("side = 'out'").select("wallet", F.col("tx").alias("prev_tx"), F.col("pos").alias("prev_pos"))
    real = cells.filter("side = 'in' and prev_tx is not null").join(made, ["wallet", "prev_tx", "prev_pos"], "left_semi")
    parents = real.groupBy("wallet", "tx").agg(F.collect_set("prev_tx").alias("parents"))
    per = cells.groupBy("wallet", "tx").agg(F.min("ts").alias("ts"), F.min("idx").alias("idx"), F.bool_or((F.col("side") == "in") & F.col("prev_tx").isNotNull()).alias("has_input"))
    rows = per.join(parents, ["wallet", "tx"], "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<bigint>")))
    ordered = rows.repartition("wallet").sortWithinPartitions("wallet", "ts", "idx", "tx")
    return ordered.select("wallet", "tx", "has_input", "parents").mapInArrow(_depths, "wallet long, depth long")


def lineage_features(cells: DataFrame) -> DataFrame:
    per = continuations(cells)
    n = F.count("*")
    agg = per.groupBy("wallet").agg(
        F.sum(F.col("i") + F.col("o")).alias("edges"), F.count_if(F.col("i") > 1).alias("merges"), F.count_if(F.col("o") > 1).alias("splits"), F.sum(F.greatest(F.col("o") - 1, F.lit(0))).alias("branches"),
        F.count_if("continues").alias("continued"), (F.count_if("continues") / n).alias("continued_ratio"),
    )
    counted = per.groupBy("wallet", "i", "o", "continues").agg(F.count("*").alias("c")).groupBy("wallet").agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repetition"))
    rows = agg.join(counted, "wallet").join(lineage_depth(cells), "wallet")
    values = {
        "merge_count": F.col("merges"), "split_count": F.col("splits"), "branch_count": F.col("branches"), "continuation_count": F.col("continued"), "continuation_ratio": F.col("continued_ratio"),
        "lineage_repetition": F.col("repetition"), "lineage_depth": F.col("depth"),
    }
    return gated(rows, values, support_state("lineage", F.col("edges")))


def template_of_cells(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """wallet, tx, ts, idx, template: SHA-256 of the canonical shape, free of hashes, blocks and times."""
    lock = F.when(F.col("target"), "TARGET").otherwise(_family(F.pmod(F.col("lock"), F.lit(5)).cast("int"), LOCK_FAMILIES))
    cell = F.concat(F.col("side"), F.lit(":"), lock, F.lit(":"), _family(F.col("type"), TYPE_FAMILIES), F.lit(":"), F.when(F.col("asset").isNotNull(), "16").otherwise("0"))
    side, t = lambda s: F.col("side") == s, F.coalesce(F.col("target"), F.lit(False))
    listed = cells.groupBy("wallet", "tx").agg(
        F.count_if(side("in")).alias("i"), F.count_if(side("out")).alias("o"), F.count_if(side("in") & t).alias("ti"), F.count_if(side("out") & t).alias("to"),
        *[F.sum(F.when(side(s), F.col("capacity"))).alias(f"{s}_total") for s in ("in", "out")], *[F.collect_list(F.when(side(s), F.col("capacity"))).alias(f"{s}_capacities") for s in ("in", "out")],
        F.array_join(F.sort_array(F.collect_list(cell)), ",").alias("cells"),
    )
    share = lambda s: F.transform(F.col(f"{s}_capacities"), lambda c: F.concat(F.lit(f"{s}="), F.bround(F.try_divide(20 * c, F.col(f"{s}_total")), 0).cast("int")))
    listed = listed.withColumn("shares", F.array_join(F.sort_array(F.concat(share("in"), share("out"))), ","))
    per = tx.select("wallet", "tx", "ts", "idx").join(listed, ["wallet", "tx"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).cast("string").alias(c) for c in ("i", "o", "ti", "to")]
    text = F.concat_ws("|", topology_of(F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))), *counts, F.coalesce("cells", F.lit("")), F.coalesce("shares", F.lit("")))
    return per.select("wallet", "tx", "ts", "idx", F.sha2(text, 256).alias("template"))


def template_features(rows: DataFrame, strength: DataFrame | None = None) -> DataFrame:
    """Template family of (wallet, tx, ts, idx, template); strength has wallet and periodicity_strength."""
    counts = rows.groupBy("wallet", "template").agg(F.count("*").alias("c"))
    ranked = counts.select(
        "wallet", "c", F.sum("c").over(Window.partitionBy("wallet")).alias("n"), F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("c"), "template")).alias("k"),
        F.sum("c").over(Window.partitionBy("wallet").orderBy(F.desc("c"), "template").rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    agg = ranked.groupBy("wallet").agg(
        F.max("n").alias("n"), F.count("*").alias("unique"), F.max("c").alias("top"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated"), S.normalized_entropy(F.col("c"), F.col("n")).alias("entropy"),
        F.count_if(F.col("c") == 1).alias("rare"), F.sum(F.when(F.col("k") <= 3, F.col("c")).otherwise(0)).alias("top3"), F.min(F.when(F.col("run") / F.col("n") >= 0.8, F.col("k"))).alias("k80"),
    )
    out = agg.join(transitions(rows, "template"), "wallet", "left")
    out = out.join(strength.select("wallet", "periodicity_strength"), "wallet", "left") if strength is not None else out.withColumn("periodicity_strength", F.lit(None).cast("double"))
    n = F.col("n")
    values = {
        "unique_template_count": F.col("unique"), "dominant_template_ratio": F.col("top") / n, "template_repeat_ratio": F.col("repeated") / n, "template_entropy": F.col("entropy"), "rare_template_ratio": F.col("rare") / n,
        "template_transition_entropy": F.col("transition_entropy"), "consecutive_template_repeat_ratio": F.col("consecutive_repeat_ratio"), "template_periodicity_support": F.col("periodicity_strength") * F.col("repeated") / n,
        "dominant_template_coverage": F.col("top3") / n, "dominant_template_count": F.col("k80"), "transition_repeat_ratio": F.col("transition_repeat_ratio"),
    }
    return gated(out, values, support_state("templates", n))
