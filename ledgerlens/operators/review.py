"""Evidence, review sets, examples, diagnostics and agreement: what a person looks at after the audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = 100
EDGES = 1000


def nearest_rank(rows: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """key, p<share>: the value at rank round((n - 1) share), half to even, counted from 0; nulls are left out."""
    known = rows.filter(F.col(value).isNotNull())
    ranked = known.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1).alias("at"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("at") == F.rint((F.col("n") - 1) * F.lit(p)), F.col(value))).alias(f"p{round(100 * p):02d}") for p in shares])


def first_and_last(tx: DataFrame) -> DataFrame:
    """wallet, first_seen, last_seen, tx_count."""
    return tx.groupBy("wallet").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("tx_count"))


def activity(wallets: DataFrame, tx: DataFrame, cells: DataFrame) -> DataFrame:
    """Transactions, inputs, outputs and target cells of every wallet; cells are counted by transaction before they are joined."""
    side = lambda s: F.count_if(F.col("side") == s)
    per = cells.groupBy("tx").agg(side("in").alias("i"), side("out").alias("o"), F.count_if("target").alias("t"))
    met = wallets.select("wallet").join(tx.select("wallet", "tx"), "wallet", "left").join(per, "tx", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.groupBy("wallet").agg(F.count("tx").alias("transaction_count"), zero("i").alias("input_count"), zero("o").alias("output_count"), zero("t").alias("observed_cell_count"))


def evidence(rows: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """wallet, rule, tx_hashes, tx_count: the first `most` distinct transactions that support a rule, and how many there are.

    Rows are cut by rank before they are listed, so a list never holds more than it returns.
    """
    distinct = rows.select("wallet", "rule", "tx").distinct()
    ranked = distinct.withColumn("place", F.row_number().over(Window.partitionBy("wallet", "rule").orderBy("tx"))).filter(F.col("place") <= most)
    listed = ranked.groupBy("wallet", "rule").agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("tx").cast("string"), 20, "0"))), ",").alias("tx_hashes"))
    return listed.join(distinct.groupBy("wallet", "rule").agg(F.count("*").alias("tx_count")), ["wallet", "rule"])


def lineage_edges(cells: DataFrame, most: int = EDGES) -> DataFrame:
    """wallet, place, tx, side, pos: the first edges of a wallet's graph in the order of time, inputs before outputs."""
    order = Window.partitionBy("wallet").orderBy("ts", "tx", "side", "pos")
    known = cells.filter((F.col("side") == "out") | F.col("prev_tx").isNotNull())
    return known.select("wallet", "tx", "side", "pos", F.row_number().over(order).alias("place")).filter(F.col("place") <= most)


def _first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).filter(F.col("place") <= n)


def review_sets(rules: DataFrame, n: int = 5) -> DataFrame:
    """rule, category, wallet, score: n strongest positives, then n borderline and n clear negatives that are other wallets.

    Borderline are the weakest positives left, then the strongest negatives.  Each set has n rows a rule, so the sets to
    leave out are broadcast.
    """
    known = rules.filter(F.col("support_state").isin("SUPPORTED", "PARTIAL") & F.col("score").isNotNull()).select("rule", "wallet", "threshold_met", F.round("score", 6).alias("score"))
    strong = _first(known.filter("threshold_met"), n, F.desc("score"), F.col("wallet"))
    rest = known.join(F.broadcast(strong.select("rule", "wallet")), ["rule", "wallet"], "left_anti")
    border = _first(rest, n, F.desc("threshold_met"), F.when(F.col("threshold_met"), F.col("score")).otherwise(-F.col("score")), F.col("wallet"))
    negative = rest.filter("not threshold_met").join(F.broadcast(border.select("rule", "wallet")), ["rule", "wallet"], "left_anti")
    negative = _first(negative, n, F.col("score"), F.col("wallet"))
    named = [df.select("rule", F.lit(name).alias("category"), "wallet", "score", "place") for name, df in (("STRONG", strong), ("BORDERLINE", border), ("NEGATIVE", negative))]
    return named[0].union(named[1]).union(named[2])


def examples(rules: DataFrame, strong: int = 10, border: int = 5) -> DataFrame:
    """rule, category, wallet, score, place: the highest scores of each rule and those nearest to two thirds."""
    known = rules.filter("score is not null").select("rule", "wallet", F.round("score", 6).alias("score"))
    top = _first(known, strong, F.desc("score"), F.col("wallet")).select("rule", F.lit("STRONG").alias("category"), "wallet", "score", "place")
    near = _first(known, border, F.round(F.abs(F.col("score") - 2 / 3), 6), F.col("wallet")).select("rule", F.lit("BORDERLINE").alias("category"), "wallet", "score", "place")
    return top.union(near)


def stratified_pick(rows: DataFrame, most: int = 8) -> DataFrame:
    """wallet, stratum, score, place: the best wallet of each stratum, then the best of all others, up to most."""
    best = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("score"), F.desc("wallet"))) == 1
    picked = rows.withColumn("best", best).orderBy(F.desc("best"), F.desc("score"), F.desc("wallet")).limit(most)
    return picked.select("wallet", "stratum", "score", F.row_number().over(Window.orderBy(F.desc("best"), F.desc("score"), F.desc("wallet"))).alias("place"))


def enrichment(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """label, rule, supported and positive wallets of the group, its share of positives over that of all groups."""
    ok = F.col("support_state").isin("SUPPORTED", "PARTIAL")
    rows = rules.join(groups.filter("label >= 0"), "wallet").select("rule", "label", ok.cast("long").alias("s"), (ok & F.col("threshold_met")).cast("long").alias("p"))
    every = rows.groupBy("rule").agg(F.sum("s").alias("all_s"), F.sum("p").alias("all_p"))
    own = rows.groupBy("rule", "label").agg(F.sum("s").alias("supported_count"), F.sum("p").alias("positive_count")).join(every, "rule")
    share, base = F.try_divide(F.col("positive_count"), F.nullif("supported_count", F.lit(0))), F.try_divide(F.col("all_p"), F.nullif("all_s", F.lit(0)))
    return own.select("label", "rule", "supported_count", "positive_count", share.alias("positive_ratio"), base.alias("cohort_positive_ratio"), F.try_divide(share, F.nullif(base, F.lit(0.0))).alias("enrichment_ratio"))


def adjusted_mutual_information(table: list[tuple[int, int, int]]) -> float:
    """Adjusted mutual information (arithmetic mean) of a contingency table of rows (left, right, n).

    The table has a row for each pair of labels that meet, however many wallets there are.
    """
    n = sum(c for *_, c in table)
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    for left, right, c in table:
        a[left], b[right] = a.get(left, 0) + c, b.get(right, 0) + c
    if n == 0 or len(a) == len(b) == 1:
        return 1.0
    entropy = lambda m: -sum(c / n * math.log(c / n) for c in m.values())
    mutual = sum(c / n * math.log(n * c / (a[left] * b[right])) for left, right, c in table)
    log_factorial = lambda k: math.lgamma(k + 1)
    expected = 0.0
    for x in a.values():
        for y in b.values():
            for c in range(max(1, x + y - n), min(x, y) + 1):
                ways = log_factorial(x) + log_factorial(y) + log_factorial(n - x) + log_factorial(n - y) - log_factorial(n) - log_factorial(c) - log_factorial(x - c) - log_factorial(y - c) - log_factorial(n - x - y + c)
                expected += c / n * math.log(n * c / (x * y)) * math.exp(ways)
    most = (entropy(a) + entropy(b)) / 2
    return (mutual - expected) / (most - expected) if abs(most - expected) > 1e-15 else 1.0


def seed_addresses(blocks: DataFrame, most: int) -> DataFrame:
    """address, block: the distinct addresses of the outputs of the latest blocks, latest first, up to most.

    blocks has number and addresses, an array.
    """
    met = blocks.select("number", F.explode("addresses").alias("address")).filter("address is not null")
    return met.groupBy("address").agg(F.max("number").alias("block")).orderBy(F.desc("block"), "address").limit(most)
