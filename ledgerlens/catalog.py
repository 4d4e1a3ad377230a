"""Registered queries of the behaviour engine, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import WINDOW_START
from ledgerlens.functions import codec
from ledgerlens.operators import audit as A
from ledgerlens.operators import cells as C
from ledgerlens.operators import explore as X
from ledgerlens.operators import normalize as N
from ledgerlens.operators import rules as R
from ledgerlens.operators import scheduler as P
from ledgerlens.operators import temporal as T
from ledgerlens.plans import profile as D
from ledgerlens.plans import sql as Q
from ledgerlens.plans.features import FAMILIES, ORDER_START, feature_matrix, feature_values, order_families, value_names
from ledgerlens.sources.adapters import cell_graph, event_stream, load, order_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

INTEGERS = set(
    "n_observed_transactions max_input_cells_per_tx max_output_cells_per_tx target_input_capacity target_output_capacity target_net_capacity_delta wallet tx lag week gaps n run started duration pos external_in external_out i o input_total output_total fee prev_tx prev_pos resolved_capacity total missing distinct_values outliers impossible wallets threshold "
    "ready families supported_wallets partial insufficient active_weeks next_week start_block end_block number median_timestamp occurrences lifetime_tx_count attempts place "
    "max_transactions_per_session max_burst_size autocorrelation_peak_lag token_input_total token_output_total net_token_delta token_turnover asset_diversity lineage_depth capacity k "
    "target_created_capacity target_consumed_capacity target_net_capacity_delta occupied_capacity_total excess_capacity_total seconds blocks high_half low_half left_label right_label amount".split()
)


def is_integer(name: str) -> bool:
    base = name.split("__")[-1]
    return base in INTEGERS or base.endswith("_count")


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, doubles rounded to six places, everything else as it is."""
    made = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("string", "boolean"):
            made.append(c)
        elif is_integer(f.name):
            made.append(c.cast("bigint").alias(f.name))
        else:
            made.append(F.round(c.cast("double"), 6).alias(f.name))
    return df.select(*made)


def query(name: str, sql: str | None = None, columns: list[str] | None = None):
    """Register a query; sql is (ctes + final FROM), columns are tidied like the DataFrame's."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def tidied(ctes: str, source: str, ints_and_doubles: list[str], texts: tuple[str, ...] = ()) -> str:
    """SQL that selects columns of a source with the types that tidy() gives."""
    made = [f"{c}" for c in texts] + [f"({c})::BIGINT AS {c}" if is_integer(c) else f"round(({c})::DOUBLE, 6) AS {c}" for c in ints_and_doubles]
    return f"{ctes}SELECT {', '.join(made)} FROM {source}"


# ---------------------------------------------------------------- temporal and periodicity
TEMPORAL = [
    "wallet", "transaction_count", "positive_gap_count", "interarrival_mean", "interarrival_median", "interarrival_std", "interarrival_cv", "interarrival_p10", "interarrival_p25", "interarrival_p75", "interarrival_p90",
    "interarrival_skewness", "interarrival_kurtosis", "gap_entropy", "activity_session_count", "mean_session_duration", "median_session_duration", "mean_transactions_per_session", "max_transactions_per_session", "burst_count",
    "mean_burst_size", "max_burst_size", "mean_burst_duration", "transactions_in_bursts_ratio", "hour_of_day_entropy", "weekday_entropy", "active_hour_concentration", "active_day_concentration",
]
PERIODICITY = [
    "wallet", "dominant_period_seconds", "periodicity_strength", "phase_stability", "autocorrelation_peak_strength", "autocorrelation_peak_lag", "interval_cluster_concentration", "dominant_interval_cluster", "dominant_interval_cluster_ratio",
    "multi_period_candidate_count", "eligible_subwindow_count", "period_presence_count", "period_stability_score", "spectral_power", "spectral_peak_ratio",
]
_EV = Q.with_(Q.EVENTS, Q.gap_table("ev"))


@query("temporal_features", tidied(Q.with_(Q.EVENTS, Q.gap_table("ev"), Q.temporal("ev")), "f_temporal", TEMPORAL, ("support_state",)))
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    return T.temporal_features(event_stream(spark, d))


@query("periodicity_features", tidied(Q.with_(Q.EVENTS, Q.gap_table("ev"), Q.periodicity("ev", WINDOW_START)), "f_periodicity", PERIODICITY, ("support_state",)))
def periodicity_features(spark: SparkSession, d: str) -> DataFrame:
    return T.periodicity_features(event_stream(spark, d), WINDOW_START)


@query("sessions", tidied(_EV, "s1", ["wallet", "run", "n", "duration", "started"]))
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.sessions(event_stream(spark, d))


@query("bursts", tidied(_EV, "b1", ["wallet", "run", "n", "duration", "started"]))
def bursts(spark: SparkSession, d: str) -> DataFrame:
    return T.bursts(event_stream(spark, d))


@query("autocorrelation", tidied(Q.with_(Q.EVENTS, Q.gap_table("ev"), Q.autocorrelation()), "ac", ["wallet", "lag", "r"]))
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return T.autocorrelation(event_stream(spark, d))


@query("weekly_gaps", tidied(Q.with_(Q.EVENTS, Q.weekly("ev", WINDOW_START)), "wk", ["wallet", "week", "gaps", "median"]))
def weekly_gaps(spark: SparkSession, d: str) -> DataFrame:
    return T.weekly_gaps(event_stream(spark, d), WINDOW_START)


@query("gap_clusters", tidied(Q.with_(Q.EVENTS, Q.gap_table("ev"), Q.clusters("pc", "g1", "gap")) , "(SELECT wallet, cid AS k, size AS n, median FROM pc)", ["wallet", "k", "n", "median"]))
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    from ledgerlens.functions.stats import array_median

    c = T.gap_clusters(event_stream(spark, d)).select("wallet", F.posexplode("clusters").alias("k", "c"))
    return c.select("wallet", (F.col("k") + 1).alias("k"), F.size("c").alias("n"), array_median(F.col("c")).alias("median"))


@query("event_templates", tidied(Q.with_(Q.EVENTS, "evt AS (SELECT wallet, ts, idx, tx, token AS template FROM ev)", Q.templates("evt")), "f_templates", TEMPLATES := [
    "wallet", "unique_template_count", "dominant_template_ratio", "template_repeat_ratio", "template_entropy", "rare_template_ratio", "template_transition_entropy", "consecutive_template_repeat_ratio",
    "template_periodicity_support", "dominant_template_coverage", "dominant_template_count", "transition_repeat_ratio"], ("support_state",)))
def event_templates(spark: SparkSession, d: str) -> DataFrame:
    return C.template_features(event_stream(spark, d).select("wallet", "tx", "ts", "idx", F.col("token").alias("template")))


# ---------------------------------------------------------------- families over the order graph
_CELLS = (Q.ORDERS, Q.CELLS)
TOPOLOGY = [
    "wallet", "one_to_one_ratio", "one_to_many_ratio", "many_to_one_ratio", "many_to_many_ratio", "other_ratio", "dominant_topology_ratio", "input_cell_count_mean", "input_cell_count_median", "input_cell_count_cv", "output_cell_count_mean",
    "output_cell_count_median", "output_cell_count_cv", "external_input_lock_mean", "external_output_lock_mean", "topology_entropy", "topology_repeat_ratio", "topology_transition_entropy", "fragmentation_event_count",
    "fragmentation_event_ratio", "mean_fragmentation_factor", "max_fragmentation_factor", "consolidation_event_count", "consolidation_event_ratio", "mean_consolidation_factor", "max_consolidation_factor",
]


@query("topology_features", tidied(Q.with_(*_CELLS, Q.SHAPES, Q.topology()), "f_topology", TOPOLOGY, ("support_state", "dominant_topology")))
def topology_features(spark: SparkSession, d: str) -> DataFrame:
    return C.topology_features(order_stream(spark, d), cell_graph(spark, d))


@query("transaction_shapes", tidied(Q.with_(*_CELLS, Q.SHAPES), "sh", ["wallet", "tx", "i", "o", "external_in", "external_out"], ("topology",)))
def transaction_shapes(spark: SparkSession, d: str) -> DataFrame:
    return C.shapes(order_stream(spark, d), cell_graph(spark, d)).select("wallet", "tx", "i", "o", "external_in", "external_out", "topology")


@query("capacity_features", tidied(Q.with_(*_CELLS, Q.capacity()), "f_capacity", CAPACITY := [
    "wallet", *[f"{s}_capacity_{k}" for s in ("input", "output") for k in ("mean", "median", "cv")], "capacity_repeat_ratio", "capacity_input_entropy", "capacity_output_entropy", "target_created_capacity",
    "target_consumed_capacity", "target_net_capacity_delta", "occupied_capacity_total", "excess_capacity_total"], ("support_state",)))
def capacity_features(spark: SparkSession, d: str) -> DataFrame:
    return C.capacity_features(cell_graph(spark, d))


@query("script_features", tidied(Q.with_(*_CELLS, Q.scripts()), "f_scripts", SCRIPTS := [
    "wallet", "unique_lock_script_count", "unique_type_script_count", "lock_family_count", "type_family_count", "lock_family_entropy", "type_family_entropy", "dominant_lock_family_ratio", "dominant_type_family_ratio",
    "unknown_lock_ratio", "unknown_type_ratio", "script_repeat_ratio", "script_transition_entropy", "script_coverage"], ("support_state",)))
def script_features(spark: SparkSession, d: str) -> DataFrame:
    return C.script_features(cell_graph(spark, d))


@query("typed_asset_features", tidied(Q.with_(*_CELLS, Q.typed_assets()), "f_typed_assets", TYPED_ASSETS := [
    "wallet", "typed_asset_count", "asset_diversity", "typed_cell_ratio", "token_input_total", "token_output_total", "net_token_delta", "token_turnover", "repeated_token_amount_ratio", "token_amount_entropy",
    "token_fanout_ratio", "token_fanin_ratio"], ("support_state",)))
def typed_asset_features(spark: SparkSession, d: str) -> DataFrame:
    return C.typed_asset_features(cell_graph(spark, d))


@query("lifecycle_features", tidied(Q.with_(*_CELLS, Q.lifecycle()), "f_lifecycle", LIFECYCLE := [
    "wallet", "observed_cell_count", "consumed_cell_count", "right_censored_cell_count", "mean_lifetime_seconds", "median_lifetime_seconds", "lifetime_std", "lifetime_cv", "lifetime_p25", "lifetime_p75", "lifetime_p90",
    "mean_lifetime_blocks", "median_lifetime_blocks", "short_lived_ratio", "long_lived_ratio", "rapid_consumption_ratio", "same_block_ratio", "lifetime_entropy", "lifetime_repeat_ratio"], ("support_state",)))
def lifecycle_features(spark: SparkSession, d: str) -> DataFrame:
    return C.lifecycle_features(cell_graph(spark, d))


@query("right_censored_cells", tidied(Q.with_(*_CELLS, Q.CENSORED), "cens", ["wallet", "tx", "pos"]))
def right_censored_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.right_censored(cell_graph(spark, d))


@query("continuations", tidied(Q.with_(*_CELLS, Q.CONTINUE), "cn_", ["wallet", "tx", "i", "o"], ("continues",)))
def continuations(spark: SparkSession, d: str) -> DataFrame:
    return C.continuations(cell_graph(spark, d)).select("wallet", "tx", "i", "o", "continues")


@query("lineage_features", tidied(Q.with_(*_CELLS, Q.lineage()), "f_lineage", LINEAGE := ["wallet", "merge_count", "split_count", "branch_count", "continuation_count", "continuation_ratio", "lineage_repetition", "lineage_depth"], ("support_state",)))
def lineage_features(spark: SparkSession, d: str) -> DataFrame:
    return C.lineage_features(cell_graph(spark, d))


@query("transaction_templates", Q.with_(*_CELLS, Q.SHAPES, Q.TEMPLATE) + "SELECT wallet::BIGINT AS wallet, tx::BIGINT AS tx, template FROM tp")
def transaction_templates(spark: SparkSession, d: str) -> DataFrame:
    return C.template_of_cells(order_stream(spark, d), cell_graph(spark, d)).select("wallet", "tx", "template")


@query("template_features", tidied(Q.with_(Q.ORDERS, Q.CELLS, Q.gap_table("otx"), Q.periodicity("otx", ORDER_START), Q.SHAPES, Q.TEMPLATE, Q.templates("tp", "strength")), "f_templates", TEMPLATES, ("support_state",)))
def template_features(spark: SparkSession, d: str) -> DataFrame:
    return order_families(spark, d)["templates"]


# ---------------------------------------------------------------- rules
_ALL = Q.everything(ORDER_START).rstrip()
_WIDE = "wide AS (SELECT * FROM (SELECT wallet, count(*) AS tn FROM otx GROUP BY wallet) " + " ".join(f"LEFT JOIN (SELECT wallet, support_state AS {f}_state, * EXCLUDE (wallet, support_state) FROM f_{f}) USING (wallet)" for f in FAMILIES) + ")"
_NET = "abs(target_net_capacity_delta) / nullif(target_created_capacity + target_consumed_capacity, 0)"
_ONE = lambda c: f"(CASE WHEN {c} IS NULL OR {c} = 0 THEN 1.0 ELSE {c} END)"
_RULES = {
    "PERIODIC_EXECUTION": (("temporal", "periodicity"), "periodicity_strength >= 0.8 AND phase_stability >= 0.75 AND interarrival_cv <= 0.35", ["periodicity_strength", "phase_stability", f"1 - least(1.0, {_ONE('interarrival_cv')})"]),
    "BATCH_DISTRIBUTION": (("topology", "templates"), "one_to_many_ratio >= 0.5 AND external_output_lock_mean >= 2 AND template_repeat_ratio >= 0.5", ["one_to_many_ratio", "CASE WHEN external_output_lock_mean IS NOT NULL THEN least(1.0, external_output_lock_mean / 2) END", "template_repeat_ratio"]),
    "FAN_IN_COLLECTION": (("topology", "templates"), "many_to_one_ratio >= 0.5 AND external_input_lock_mean >= 2 AND topology_repeat_ratio >= 0.5", ["many_to_one_ratio", "CASE WHEN external_input_lock_mean IS NOT NULL THEN least(1.0, external_input_lock_mean / 2) END", "topology_repeat_ratio"]),
    "BURST_EXECUTION": (("temporal",), "burst_count >= 2 AND transactions_in_bursts_ratio >= 0.5", ["CASE WHEN burst_count IS NOT NULL THEN least(1.0, burst_count / 2) END", "transactions_in_bursts_ratio"]),
    "CELL_FRAGMENTATION": (("topology",), "fragmentation_event_ratio >= 0.3 AND mean_fragmentation_factor >= 2", ["fragmentation_event_ratio", "CASE WHEN mean_fragmentation_factor IS NOT NULL THEN least(1.0, mean_fragmentation_factor / 2) END"]),
    "CELL_CONSOLIDATION": (("topology",), "consolidation_event_ratio >= 0.3 AND mean_consolidation_factor >= 2", ["consolidation_event_ratio", "CASE WHEN mean_consolidation_factor IS NOT NULL THEN least(1.0, mean_consolidation_factor / 2) END"]),
    "SCRIPT_TEMPLATE_REPETITION": (("templates", "scripts"), "template_repeat_ratio >= 0.5 AND dominant_template_ratio >= 0.3", ["template_repeat_ratio", "dominant_template_ratio"]),
    "RAPID_CELL_TURNOVER": (("lifecycle",), "rapid_consumption_ratio >= 0.5", ["rapid_consumption_ratio"]),
    "PASS_THROUGH_CANDIDATE": (("lifecycle", "lineage", "capacity"), f"rapid_consumption_ratio >= 0.5 AND continuation_ratio >= 0.5 AND {_NET} <= 0.05", ["rapid_consumption_ratio", "continuation_ratio", f"CASE WHEN {_NET} IS NULL THEN 0.0 ELSE 1 - least(1.0, {_NET}) END"]),
    "STATE_MACHINE_ACTIVITY": (("templates",), f"tn >= 10 AND dominant_template_count <= 3 AND dominant_template_coverage >= 0.8 AND transition_repeat_ratio >= 0.6 AND {_ONE('template_transition_entropy')} <= 0.5", ["dominant_template_coverage", "transition_repeat_ratio", f"1 - {_ONE('template_transition_entropy')}"]),
    "IRREGULAR_ACTIVITY": (("temporal", "periodicity", "templates"), "tn >= 8 AND coalesce(periodicity_strength, 0) < 0.3 AND gap_entropy >= 0.7 AND coalesce(template_repeat_ratio, 0) < 0.3", ["1 - periodicity_strength", "gap_entropy", "1 - template_repeat_ratio"]),
}


def _rule_sql(name: str) -> str:
    families, met, parts = _RULES[name]
    states = "[" + ", ".join(f"coalesce({f}_state, 'INSUFFICIENT_EVIDENCE')" for f in families) + "]"
    state = f"CASE WHEN list_contains({states}, 'INSUFFICIENT_EVIDENCE') THEN 'INSUFFICIENT_EVIDENCE' WHEN list_contains({states}, 'PARTIAL') THEN 'PARTIAL' ELSE 'SUPPORTED' END"
    mean = f"({' + '.join(f'coalesce(({p})::DOUBLE, 0)' for p in parts)}) / nullif({' + '.join(f'(({p}) IS NOT NULL)::INT' for p in parts)}, 0)"
    return f"SELECT wallet, '{name}' AS rule, {state} AS support_state, CASE WHEN {state} <> 'INSUFFICIENT_EVIDENCE' THEN {mean} END AS score, coalesce({met}, false) AS threshold_met, coalesce({met}, false) AND {state} <> 'INSUFFICIENT_EVIDENCE' AS positive FROM wide"


_RULE_CTE = ",\n" + _WIDE + ",\nrl AS (" + " UNION ALL ".join(_rule_sql(r) for r in _RULES) + """),
rr AS (SELECT * FROM rl UNION ALL SELECT wallet, 'MIXED', CASE WHEN k >= 2 THEN 'SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END, CASE WHEN k > 0 THEN least(1.0, k / 3) END, k >= 2, k >= 2 FROM (SELECT wallet, count(*) FILTER (positive) AS k FROM rl GROUP BY wallet))
"""


@query("rules_v2", tidied(_ALL + _RULE_CTE, "rr", ["wallet", "score"], ("rule", "support_state", "threshold_met", "positive")))
def rules_v2(spark: SparkSession, d: str) -> DataFrame:
    return R.evaluate(feature_matrix(spark, d))


@query("rule_counts", tidied(_ALL + _RULE_CTE, "(SELECT rule, support_state, count(*) AS wallets, count(*) FILTER (threshold_met) AS threshold_count, count(*) FILTER (positive) AS positive_count FROM rr GROUP BY ALL)", ["wallets", "threshold_count", "positive_count"], ("rule", "support_state")))
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    r = R.evaluate(feature_matrix(spark, d))
    return r.groupBy("rule", "support_state").agg(F.count("*").alias("wallets"), F.count_if("threshold_met").alias("threshold_count"), F.count_if("positive").alias("positive_count"))


# ---------------------------------------------------------------- feature matrix and audits
#: Numeric values of the nine families, as the SQL below lists them.
_VALUES = {
    "temporal": TEMPORAL[1:], "periodicity": PERIODICITY[1:], "topology": TOPOLOGY[1:], "lifecycle": LIFECYCLE[1:], "templates": TEMPLATES[1:], "scripts": SCRIPTS[1:],
    "typed_assets": TYPED_ASSETS[1:], "capacity": CAPACITY[1:], "lineage": LINEAGE[1:],
}
_LONG = "lf_ AS (" + " UNION ALL ".join(f"SELECT wallet, '{f}__{v}' AS feature, round(({v})::DOUBLE, 6) AS value FROM wide" for f in FAMILIES for v in _VALUES[f]) + ")"
_MATRIX = f"{_ALL},\n{_WIDE},\n{_LONG}"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.long_form(feature_matrix(spark, d).drop("topology__n"))


@query("feature_matrix_long", tidied(_MATRIX + "\n", "lf_", ["wallet", "value"], ("feature",)))
def feature_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query("learning_columns", "SELECT unnest([" + ", ".join(f"'{c}'" for c in sorted(f"{f}__{v}" for f in FAMILIES for v in _VALUES[f] if not any(t in f"{f}__{v}" for t in __import__("ledgerlens.config", fromlist=["x"]).FORBIDDEN_TOKENS))) + "]) AS feature")
def learning_columns(spark: SparkSession, d: str) -> DataFrame:
    names = A.learning_columns(feature_matrix(spark, d, []).drop("topology__n"))  # the plan of no wallet: only its columns are read
    return spark.createDataFrame([(n,) for n in names], "feature string")


_AUDIT = r"""au_m AS (SELECT feature, max(c) AS top, count(*) AS vals FROM (SELECT feature, value, count(*) AS c FROM lf_ WHERE value IS NOT NULL GROUP BY ALL) GROUP BY feature),
au_q AS (SELECT feature, count(*) AS total, count(value) AS n, min(value) AS low, max(value) AS high, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99 FROM lf_ GROUP BY feature),
au_i AS (SELECT feature, count(*) FILTER (p75 > p25 AND (value < p25 - 3 * (p75 - p25) OR value > p75 + 3 * (p75 - p25))) AS outliers,
  count(*) FILTER (regexp_matches(feature, '_(ratio|entropy|concentration|repetition|strength)$') AND NOT regexp_matches(feature, 'autocorrelation') AND (value < -1e-6 OR value > 1 + 1e-6)) AS impossible FROM lf_ JOIN au_q USING (feature) GROUP BY feature),
au AS (SELECT feature, total, n, total - n AS missing, coalesce(vals, 0) AS distinct_values, top / n AS mode_ratio, low, high, p01, p25, p50, p75, p99, outliers, impossible,
  CASE WHEN impossible > 0 THEN 'SUSPICIOUS' WHEN coalesce(vals, 0) <= 1 THEN 'CONSTANT' WHEN top / n >= 0.99 THEN 'NEAR_CONSTANT' WHEN n / total < 0.2 THEN 'VERY_SPARSE' WHEN n / total < 0.5 THEN 'SPARSE' ELSE 'USABLE' END AS classification
  FROM au_q LEFT JOIN au_m USING (feature) LEFT JOIN au_i USING (feature))"""
_AUDIT_COLUMNS = ["total", "n", "missing", "distinct_values", "mode_ratio", "low", "high", "p01", "p25", "p50", "p75", "p99", "outliers", "impossible"]


@query("predictor_audit", tidied(f"{_MATRIX},\n{_AUDIT}\n", "au", _AUDIT_COLUMNS, ("feature", "classification")))
def predictor_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.predictor_audit(feature_values(spark, d))


_CORRELATED = """{name}_k AS (SELECT *, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2 AS ry FROM {name}_0),
{name} AS (SELECT l, r, count(*) AS n, CASE WHEN count(*) >= 2 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS pearson, CASE WHEN count(*) >= 2 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS spearman FROM {name}_k GROUP BY l, r)"""
_PAIRS = f"{_MATRIX},\npx_0 AS (SELECT a.feature AS l, b.feature AS r, a.value AS x, b.value AS y FROM lf_ a JOIN lf_ b ON a.wallet = b.wallet AND a.feature < b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL),\n" + _CORRELATED.format(name="px")
_STRONG = "strong AS (SELECT l, r, n, round(greatest(abs(pearson), abs(spearman)), 6) AS strength, CASE WHEN round(greatest(abs(pearson), abs(spearman)), 6) >= 0.95 THEN 'KEEP_ONE' ELSE 'REVIEW' END AS advice FROM px WHERE n >= 50 AND round(greatest(abs(pearson), abs(spearman)), 6) >= 0.9)"


@query("pair_correlations", tidied(_PAIRS + "\n", "px", ["n", "pearson", "spearman"], ("l", "r")))
def pair_correlations(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_correlations(feature_values(spark, d))


@query("redundancy_pairs", tidied(f"{_PAIRS},\n{_STRONG}\n", "strong", ["n", "strength"], ("l", "r", "advice")))
def redundancy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.redundancy(A.pair_correlations(feature_values(spark, d)))


_GROUPS = """gr_e AS (SELECT l AS a, r AS b FROM strong WHERE advice = 'KEEP_ONE' UNION SELECT r, l FROM strong WHERE advice = 'KEEP_ONE'),
gr_r AS (SELECT a AS feature, a AS here FROM gr_e UNION SELECT gr_r.feature, gr_e.b FROM gr_r JOIN gr_e ON gr_r.here = gr_e.a),
gr AS (SELECT feature, min(here) AS root FROM gr_r GROUP BY feature)"""


@query("redundancy_groups", f"{_PAIRS},\n{_STRONG},\n{_GROUPS}\nSELECT feature, root FROM gr")
def redundancy_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.redundancy_groups(A.redundancy(A.pair_correlations(feature_values(spark, d))))


_LEAK = f"""act AS (SELECT wallet, 'transactions' AS metric, count(*)::DOUBLE AS level FROM otx GROUP BY wallet UNION ALL SELECT wallet, 'cells', count(*)::DOUBLE FROM cells GROUP BY wallet),
lk_0 AS (SELECT feature AS l, metric AS r, value AS x, level AS y FROM lf_ JOIN act USING (wallet) WHERE value IS NOT NULL),
{_CORRELATED.format(name="lk")},
leak AS (SELECT l AS feature, r AS metric, n, pearson, spearman, CASE WHEN round(greatest(coalesce(abs(pearson), 0), coalesce(abs(spearman), 0)), 6) >= 0.8 THEN 'HIGH' WHEN round(greatest(coalesce(abs(pearson), 0), coalesce(abs(spearman), 0)), 6) >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM lk WHERE n >= 30)"""


def _leakage(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, name: df.groupBy("wallet").agg(F.count("*").cast("double").alias(name))
    activity = count(order_stream(spark, d), "transactions").join(count(cell_graph(spark, d), "cells"), "wallet", "left")
    return A.activity_leakage(feature_values(spark, d), activity)


@query("activity_leakage", tidied(f"{_MATRIX},\n{_LEAK}\n", "leak", ["n", "pearson", "spearman"], ("feature", "metric", "risk")))
def activity_leakage(spark: SparkSession, d: str) -> DataFrame:
    return _leakage(spark, d)


@query("candidate_sets", f"""{_PAIRS},\n{_STRONG},\n{_GROUPS},\n{_AUDIT},\n{_LEAK},
le AS (SELECT feature, max(CASE risk WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END) AS leak FROM leak GROUP BY feature),
cs AS (SELECT feature, classification IN ('USABLE', 'SPARSE') AND coalesce(le.leak, 0) < 2 AS broad, classification = 'USABLE' AS usable, root IS NULL OR root = feature AS head, coalesce(le.leak, 0) = 0 AS clean FROM au LEFT JOIN le USING (feature) LEFT JOIN gr USING (feature))
SELECT feature, broad, broad AND usable AS core, broad AND usable AND head AS low_redundancy, broad AND usable AND head AND clean AS high_confidence FROM cs""")
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    m = feature_values(spark, d)
    return A.candidate_sets(A.predictor_audit(m), _leakage(spark, d), A.redundancy_groups(A.redundancy(A.pair_correlations(m))))


_PATTERN = "concat_ws('+', " + ", ".join(f"CASE WHEN {f}_state = 'SUPPORTED' THEN '{f}' END" for f in FAMILIES) + ")"


@query("missing_patterns", f"{_ALL},\n{_WIDE}\nSELECT {_PATTERN} AS pattern, count(*)::BIGINT AS wallets FROM wide GROUP BY 1")
def missing_patterns(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_patterns(feature_matrix(spark, d), list(FAMILIES))


_SUPPORTED = " + ".join(f"(coalesce({f}_state, '') = 'SUPPORTED')::INT" for f in FAMILIES)


@query("cohorts", f"{_ALL},\n{_WIDE}\nSELECT t::BIGINT AS threshold, count(*) FILTER ({_SUPPORTED} >= t)::BIGINT AS wallets FROM wide CROSS JOIN range(1, 8) r(t) GROUP BY t")
def cohorts(spark: SparkSession, d: str) -> DataFrame:
    return A.cohorts(feature_matrix(spark, d), list(FAMILIES))


_CONTRIBUTION = "fc AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS family, count(*) AS wallets, count(*) FILTER ({f}_state = 'SUPPORTED') AS supported_count, count(*) FILTER ({f}_state = 'PARTIAL') AS partial_count, count(*) FILTER (coalesce({f}_state, 'MISSING') IN ('MISSING', 'INSUFFICIENT_EVIDENCE')) AS insufficient_count, count(*) FILTER ({f}_state = 'SUPPORTED') / count(*) AS share FROM wide" for f in FAMILIES) + ")"


@query("family_contribution", tidied(f"{_ALL},\n{_WIDE},\n{_CONTRIBUTION}\n", "fc", ["wallets", "supported_count", "partial_count", "insufficient_count", "share"], ("family",)))
def family_contribution(spark: SparkSession, d: str) -> DataFrame:
    c = A.family_contribution(feature_matrix(spark, d), list(FAMILIES))
    return c.select("family", "wallets", F.col("supported").alias("supported_count"), F.col("partial").alias("partial_count"), F.col("insufficient").alias("insufficient_count"), "share")


@query("readiness", f"""{_ALL},\n{_WIDE},\n{_CONTRIBUTION}
SELECT t.share, count(*) FILTER (fc.share >= t.share)::BIGINT AS ready, count(*)::BIGINT AS families, CASE WHEN count(*) FILTER (fc.share >= t.share) = count(*) THEN 'READY' WHEN count(*) FILTER (fc.share >= t.share) > 0 THEN 'PARTIAL' ELSE 'NOT READY' END AS status
FROM fc CROSS JOIN (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(share) GROUP BY t.share""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return A.readiness(feature_matrix(spark, d), list(FAMILIES))


@query("distribution_issues", tidied(f"""{_MATRIX},
di_q AS (SELECT feature, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM lf_ GROUP BY feature),
di AS (SELECT feature, wallet, value, round(abs(value - p50), 6) AS distance FROM lf_ JOIN di_q USING (feature) WHERE p75 > p25 AND (value < p25 - 3 * (p75 - p25) OR value > p75 + 3 * (p75 - p25))),
dr AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY distance DESC, wallet DESC) AS place FROM di)
""", "(SELECT * FROM dr WHERE place <= 5)", ["wallet", "value", "distance", "place"], ("feature",)))
def distribution_issues(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution_issues(feature_values(spark, d))


_WEEKS = f"""wc AS (SELECT wallet, (ts - {WINDOW_START}) // 604800 AS week, count(*) AS n FROM ev WHERE ts >= {WINDOW_START} AND (ts - {WINDOW_START}) // 604800 < 4 GROUP BY ALL)"""


@query("weekly_stability", tidied(Q.with_(Q.EVENTS, _WEEKS, f"""wg AS (SELECT w.wallet, r.week, coalesce(n, 0) AS n FROM (SELECT DISTINCT wallet FROM ev) w CROSS JOIN range(0, 4) r(week) LEFT JOIN wc ON wc.wallet = w.wallet AND wc.week = r.week),
ws AS (SELECT wallet, sum(n) AS total, var_pop(n) AS variance, {Q.cv('n')} AS cv, count(*) FILTER (n > 0) AS active_weeks FROM wg GROUP BY wallet)"""), "ws", ["wallet", "total", "variance", "cv", "active_weeks"]))
def weekly_stability(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly_stability(event_stream(spark, d), WINDOW_START)[0]


@query("adjacent_weeks", tidied(Q.with_(Q.EVENTS, _WEEKS, "aw_0 AS (SELECT a.week AS l, b.week AS r, a.n::DOUBLE AS x, b.n::DOUBLE AS y FROM wc a JOIN wc b ON a.wallet = b.wallet AND b.week = a.week + 1)", _CORRELATED.format(name="aw")), "(SELECT l AS week, r AS next_week, n, spearman FROM aw WHERE n >= 10)", ["week", "next_week", "n", "spearman"]))
def adjacent_weeks(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly_stability(event_stream(spark, d), WINDOW_START)[1]


# ---------------------------------------------------------------- normalisation, resolution, scheduling
_FEE = "cast(round(o_totalprice) as bigint) % 3"


@query("conservation", tidied(Q.with_(*_CELLS, """cs_p AS (SELECT tx, count(*) FILTER (side = 'in') AS ni, count(*) FILTER (side = 'out') AS no_, sum(capacity) FILTER (side = 'in') AS si, sum(capacity) FILTER (side = 'out') AS so FROM cells GROUP BY tx),
cs_t AS (SELECT t.tx, o.o_custkey % 5 AS fee0, ni, no_, si, so FROM otx t JOIN orders o ON o.o_orderkey = t.tx LEFT JOIN cs_p USING (tx)),
cs_f AS (SELECT tx, CASE WHEN ni > 0 THEN si END AS input_total, CASE WHEN no_ IS NOT NULL THEN coalesce(so, 0) END AS output_total, fee0 FROM cs_t),
cs AS (SELECT tx, input_total, output_total, input_total - output_total AS fee, CASE WHEN input_total IS NULL OR output_total IS NULL THEN 'incomplete' WHEN input_total < output_total OR input_total - output_total <> fee0 THEN 'failed' ELSE 'complete' END AS status FROM cs_f)"""), "cs", ["tx", "input_total", "output_total", "fee"], ("status",)))
def conservation(spark: SparkSession, d: str) -> DataFrame:
    tx = order_stream(spark, d).select("tx", (F.col("wallet") % 5).alias("reported_fee"))
    cells = cell_graph(spark, d).select("tx", "side", "capacity", F.lit("complete").alias("resolution_status"))
    return N.conservation(tx, cells)


@query("resolve_inputs", tidied(Q.with_(*_CELLS, """rs_i AS (SELECT wallet, tx, prev_tx, prev_pos FROM cells WHERE side = 'in'),
rs_a AS (SELECT tx, pos, capacity, lock FROM cells WHERE side = 'out' AND tx % 3 = 0), rs_b AS (SELECT tx, pos, capacity, lock FROM cells WHERE side = 'out' AND tx % 3 <= 1),
rs AS (SELECT i.wallet, i.tx, i.prev_tx, i.prev_pos, coalesce(a.capacity, b.capacity) AS resolved_capacity, CASE WHEN a.tx IS NOT NULL THEN 'local' WHEN b.tx IS NOT NULL THEN 'raw_cache' END AS resolution_source, CASE WHEN a.tx IS NOT NULL OR b.tx IS NOT NULL THEN 'complete' ELSE 'missing' END AS resolution_status
  FROM rs_i i LEFT JOIN rs_a a ON a.tx = i.prev_tx AND a.pos = i.prev_pos LEFT JOIN rs_b b ON b.tx = i.prev_tx AND b.pos = i.prev_pos)"""), "rs", ["wallet", "tx", "prev_tx", "prev_pos", "resolved_capacity"], ("resolution_source", "resolution_status")))
def resolve_inputs(spark: SparkSession, d: str) -> DataFrame:
    cells = cell_graph(spark, d)
    made = cells.filter("side = 'out'").select("tx", "pos", "capacity", "lock")
    inputs = cells.filter("side = 'in'").select("wallet", "tx", "prev_tx", "prev_pos")
    return N.resolve_inputs(inputs, [("local", made.filter("tx % 3 = 0")), ("raw_cache", made.filter("tx % 3 <= 1"))]).drop("resolved_lock")


@query("payload_fields", "SELECT event_id::BIGINT AS tx, json_extract_string(props, '$.k')::BIGINT AS amount FROM events")
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("tx"), codec.to_int(F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')")).alias("amount"))


@query("observation_ids", f"SELECT DISTINCT user_id::BIGINT AS wallet, sha256('mainnet|' || user_id || '|{WINDOW_START}|{WINDOW_START + 30 * 86400}|30-days-1') AS observation FROM events")
def observation_ids(spark: SparkSession, d: str) -> DataFrame:
    end = WINDOW_START + 30 * 86400
    N.check_window(WINDOW_START, end)
    w = event_stream(spark, d).select("wallet").distinct()
    return w.select("wallet", N.observation_id(F.col("wallet").cast("string"), F.lit(WINDOW_START), F.lit(end), "30-days-1").alias("observation"))


@query("window_counts", tidied(Q.with_(Q.EVENTS), f"(SELECT wallet, count(*) AS n FROM ev WHERE ts >= {WINDOW_START} AND ts < {WINDOW_START + 30 * 86400} GROUP BY wallet)", ["wallet", "n"]))
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).filter(N.in_window(F.col("ts"), WINDOW_START, WINDOW_START + 30 * 86400)).groupBy("wallet").agg(F.count("*").alias("n"))


@query("latest_observation", tidied(Q.with_(Q.EVENTS), "(SELECT wallet, tx, ts AS started FROM ev QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, tx DESC) = 1)", ["wallet", "tx", "started"]))
def latest_observation(spark: SparkSession, d: str) -> DataFrame:
    return N.latest(event_stream(spark, d), ["wallet"], ["ts", "tx"]).select("wallet", "tx", F.col("ts").alias("started"))


@query("window_boundaries", f"""WITH b AS (SELECT event_id AS number, floor(epoch(ts))::BIGINT AS t FROM events), w AS (SELECT k AS week, {WINDOW_START} + k * 604800 AS s, {WINDOW_START} + (k + 1) * 604800 AS e FROM range(0, 4) r(k))
SELECT week::BIGINT AS week, min(number)::BIGINT AS start_block, max(number)::BIGINT AS end_block FROM w JOIN b ON t >= s AND t <= e GROUP BY week""")
def window_boundaries(spark: SparkSession, d: str) -> DataFrame:
    blocks = event_stream(spark, d).select(F.col("tx").alias("number"), F.col("ts").alias("timestamp"))
    windows = spark.createDataFrame([(k, WINDOW_START + k * 604800, WINDOW_START + (k + 1) * 604800) for k in range(4)], "window long, start long, end long")
    return N.boundaries(blocks, windows).withColumnRenamed("window", "week")


@query("rolling_median", """WITH b AS (SELECT event_id AS number, floor(epoch(ts))::BIGINT AS t FROM events), l AS (SELECT number, t, list(t) OVER (ORDER BY number ROWS BETWEEN 37 PRECEDING AND 1 PRECEDING) AS a FROM b),
s AS (SELECT number, CASE WHEN a IS NULL OR len(a) = 0 THEN [t] ELSE list_sort(a) END AS a FROM l)
SELECT number::BIGINT AS number, a[((len(a) + 1) // 2)]::BIGINT AS median_timestamp FROM s""")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return N.rolling_median_low(event_stream(spark, d).select(F.col("tx").alias("number"), F.col("ts").alias("timestamp"))).select("number", "median_timestamp")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    o, e = load(spark, d, "orders"), load(spark, d, "customer")
    a = o.select(F.col("o_custkey").cast("string").alias("address"), F.lit("orders").alias("source"), F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 7).alias("tx_count"), F.lit(1).alias("priority"))
    b = e.select(F.col("c_custkey").cast("string").alias("address"), F.lit("customer").alias("source"), F.lit(None).cast("string").alias("label"), (F.col("c_custkey") % 6000).alias("tx_count"), F.lit(0).alias("priority"))
    return a.union(b)


_MANIFEST = """mf AS (SELECT o_custkey::VARCHAR AS address, 'orders' AS source, o_orderstatus AS label, o_orderkey % 7 AS tx_count, 1 AS priority FROM orders UNION ALL SELECT c_custkey::VARCHAR, 'customer', NULL, c_custkey % 6000, 0 FROM customer),
mg AS (SELECT address, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS occurrences, CASE WHEN count(DISTINCT label) = 1 THEN min(label) WHEN count(DISTINCT label) > 1 THEN 'UNKNOWN' END AS label,
  arg_min(tx_count, {'p': priority, 's': source, 't': tx_count}) AS lifetime_tx_count, CASE WHEN count(DISTINCT tx_count) > 1 THEN 'CONFLICT' ELSE 'KNOWN' END AS lifetime_status FROM mf GROUP BY address),
mh AS (SELECT *, CASE WHEN lifetime_tx_count IS NULL OR lifetime_tx_count <= 0 THEN 'unknown' WHEN lifetime_tx_count <= 10 THEN '1-10' WHEN lifetime_tx_count <= 50 THEN '11-50' WHEN lifetime_tx_count <= 200 THEN '51-200' WHEN lifetime_tx_count <= 500 THEN '201-500' WHEN lifetime_tx_count <= 1000 THEN '501-1000' WHEN lifetime_tx_count <= 5000 THEN '1001-5000' ELSE '5000+' END AS stratum FROM mg)"""


@query("manifest", tidied(f"WITH {_MANIFEST}\n", "mh", ["occurrences", "lifetime_tx_count"], ("address", "sources", "label", "lifetime_status", "stratum")))
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return P.build_manifest(_sources(spark, d))


@query("stratum_counts", f"WITH {_MANIFEST}\nSELECT stratum, count(*)::BIGINT AS wallets FROM mh GROUP BY stratum")
def stratum_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.build_manifest(_sources(spark, d)).groupBy("stratum").agg(F.count("*").alias("wallets"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").filter("c_custkey % 4 <> 0")
    k = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    return c.select(k.cast("string").alias("address"), pick(["NOT_STARTED", "IN_PROGRESS", "COMPLETE", "PARTIAL", "INVALID_ADDRESS"], k).alias("collection_state"), F.pmod(k, F.lit(4)).cast("int").alias("attempts"), pick(["ZERO_REMOTE", "PARTIAL_REFILL", "FULL_COLLECTION"], k).alias("category"))


def _new_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.cast("string").alias("address"), P.requirement(F.pmod(k, F.lit(10)), F.lit(7)).alias("category"))


_STATES = """sc0 AS (SELECT c_custkey::VARCHAR AS address, (['NOT_STARTED', 'IN_PROGRESS', 'COMPLETE', 'PARTIAL', 'INVALID_ADDRESS'])[c_custkey % 5 + 1] AS collection_state, c_custkey % 4 AS attempts, (['ZERO_REMOTE', 'PARTIAL_REFILL', 'FULL_COLLECTION'])[c_custkey % 3 + 1] AS category FROM customer WHERE c_custkey % 4 <> 0),
sc1 AS (SELECT c_custkey::VARCHAR AS address, CASE WHEN c_custkey % 10 >= 7 THEN 'ZERO_REMOTE' WHEN c_custkey % 10 > 0 THEN 'PARTIAL_REFILL' ELSE 'FULL_COLLECTION' END AS category FROM customer),
sc2 AS (SELECT address, coalesce(collection_state, 'NOT_STARTED') AS collection_state, coalesce(attempts, 0) AS attempts, CASE WHEN collection_state IN ('COMPLETE', 'INVALID_ADDRESS', 'FAILED_RETRY_EXHAUSTED') THEN sc0.category ELSE coalesce(sc1.category, sc0.category) END AS category FROM sc0 FULL JOIN sc1 USING (address)),
sc3 AS (SELECT * REPLACE (CASE WHEN collection_state = 'IN_PROGRESS' THEN 'PARTIAL' ELSE collection_state END AS collection_state) FROM sc2),
sc4 AS (SELECT * REPLACE (CASE WHEN collection_state NOT IN ('COMPLETE', 'INVALID_ADDRESS', 'FAILED_RETRY_EXHAUSTED') AND attempts >= 3 THEN 'FAILED_RETRY_EXHAUSTED' ELSE collection_state END AS collection_state) FROM sc3)"""


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    return P.finalize(P.recover(P.merge_states(_states(spark, d), _new_manifest(spark, d))))


@query("scheduler_states", tidied(f"WITH {_STATES}\n", "sc4", ["attempts"], ("address", "collection_state", "category")))
def scheduler_states(spark: SparkSession, d: str) -> DataFrame:
    return _scheduled(spark, d)


@query("next_wallets", tidied(f"WITH {_STATES}\n", "(SELECT * FROM sc4 WHERE collection_state = 'NOT_STARTED' AND attempts < 3 ORDER BY CASE category WHEN 'ZERO_REMOTE' THEN 0 WHEN 'PARTIAL_REFILL' THEN 1 WHEN 'FULL_COLLECTION' THEN 2 ELSE 9 END, attempts, address LIMIT 25)", ["attempts"], ("address", "category")))
def next_wallets(spark: SparkSession, d: str) -> DataFrame:
    return P.next_wallets(_scheduled(spark, d), 25).select("address", "category", "attempts")


@query("evidence_states", f"WITH {_STATES}\nSELECT CASE WHEN collection_state = 'INVALID_ADDRESS' THEN 'UNRESOLVED' WHEN collection_state = 'COMPLETE' AND attempts < 2 THEN 'SUPPORTED' WHEN collection_state IN ('COMPLETE', 'PARTIAL', 'FAILED_RETRY_EXHAUSTED') THEN 'PARTIAL' ELSE 'INSUFFICIENT_EVIDENCE' END AS evidence, count(*)::BIGINT AS wallets FROM sc4 GROUP BY 1")
def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    s = _scheduled(spark, d)
    return s.groupBy(P.evidence_state(F.col("collection_state"), F.col("attempts") < 2, F.lit(True)).alias("evidence")).agg(F.count("*").alias("wallets"))


@query("typed_amounts", "SELECT l_orderkey::BIGINT AS tx, l_partkey::BIGINT AS low_half, 0::BIGINT AS high_half, CASE WHEN l_linestatus = 'O' THEN 'DECODED' ELSE 'METADATA_MISMATCH' END AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def typed_amounts(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.lpad(F.hex("l_partkey"), 16, "0").alias("digits"))
    line = line.select("l_orderkey", "l_linestatus", F.concat(F.lit("0x"), *[F.substring("digits", 15 - 2 * i, 2) for i in range(8)], F.lit("0" * 16)).alias("data"))
    high, low = codec.u128(F.col("data"))
    rows = line.select(F.col("l_orderkey").alias("tx"), low.alias("low_half"), high.alias("high_half"), codec.decode_status(F.col("l_linestatus") == "O", F.col("data")).alias("status"))
    return rows.groupBy("tx", "low_half", "high_half", "status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- exploration
#: Features of the learning matrix of the PCA and the clusterings, a parameter: complete cases of these are its rows.
EXPLORED = [f"{f}__{v}" for f, v in (
    ("temporal", "interarrival_mean"), ("temporal", "interarrival_median"), ("temporal", "interarrival_std"), ("temporal", "interarrival_cv"), ("temporal", "gap_entropy"), ("topology", "input_cell_count_mean"), ("topology", "output_cell_count_mean"),
    ("topology", "fragmentation_event_ratio"), ("topology", "consolidation_event_ratio"), ("topology", "topology_entropy"), ("capacity", "input_capacity_mean"), ("capacity", "output_capacity_mean"), ("capacity", "target_created_capacity"), ("capacity", "occupied_capacity_total"),
)]
_SCALED = f"""sv_t AS (SELECT wallet, feature, regexp_matches(feature, '_(ratio|entropy|cv|concentration|repetition|strength|stability|skewness|kurtosis)$') AS std_, CASE WHEN regexp_matches(feature, '_(ratio|entropy|cv|concentration|repetition|strength|stability|skewness|kurtosis)$') THEN value ELSE sign(value) * ln(1 + abs(value)) END AS t FROM lf_ WHERE value IS NOT NULL),
sv_s AS (SELECT feature, avg(t) AS m, stddev_pop(t) AS s, quantile_cont(t, 0.25) AS a, quantile_cont(t, 0.5) AS b, quantile_cont(t, 0.75) AS c FROM sv_t GROUP BY feature),
sv AS (SELECT wallet, feature, CASE WHEN std_ OR c = a THEN (t - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END ELSE (t - b) / (c - a) END AS scaled FROM sv_t JOIN sv_s USING (feature))"""


_IN = ", ".join(repr(f) for f in EXPLORED)


def _scaled(spark: SparkSession, d: str, features: list[str] | None = None) -> DataFrame:
    """Scaled values of the named features, or of all, one wide row a wallet."""
    m = feature_values(spark, d)
    return X.scaled_wide(m if features is None else m.select("wallet", *features))


@query("scaled_values", tidied(f"{_MATRIX},\n{_SCALED}\n", "sv", ["wallet", "scaled"], ("feature",)))
def scaled_values(spark: SparkSession, d: str) -> DataFrame:
    return X.to_long(_scaled(spark, d))


@query("feature_covariance", tidied(f"{_MATRIX},\n{_SCALED}\n", f"(SELECT a.feature AS l, b.feature AS r, covar_samp(a.scaled, b.scaled) AS covariance FROM sv a JOIN sv b USING (wallet) WHERE a.feature IN ({_IN}) AND b.feature IN ({_IN}) GROUP BY 1, 2)", ["covariance"], ("l", "r")))
def feature_covariance(spark: SparkSession, d: str) -> DataFrame:
    return X.covariance_long(_scaled(spark, d, EXPLORED))


@query("pca_variance")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    scaled = _scaled(spark, d, EXPLORED)
    names = sorted(X.K.names_of(scaled))
    n, _, covariance = X.K.complete_covariance(scaled, names)
    share = X.principal(covariance)[0]
    rows = [(i + 1, float(s), float(share[: i + 1].sum()), X.feasible(n, len(names))) for i, s in enumerate(share)]
    return spark.createDataFrame(rows, "k long, share double, cumulative double, feasible boolean")


@query("pca_stability")
def pca_stability(spark: SparkSession, d: str) -> DataFrame:
    b = X.pca_bootstrap(_scaled(spark, d, EXPLORED))
    return b.groupBy(F.col("component").alias("k")).agg(F.count("*").alias("n"), F.median("cosine").alias("median"), F.min("cosine").alias("low"), F.avg(F.col("in_order").cast("double")).alias("order_retention"))


#: Blocks of the learning matrix and the numbers of their first components that are clustered beside their scaled values.
VIEWS = {"HIGH_CONFIDENCE": (EXPLORED, (3, 4, 6)), "TEMPORAL_STRUCTURE": ([f for f in EXPLORED if f.startswith("temporal__")], (3,)), "CELL_STRUCTURE": ([f for f in EXPLORED if not f.startswith("temporal__")], (7,))}


@query("density_grid")
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    runs = X.grid(_scaled(spark, d, EXPLORED), VIEWS)
    return runs.groupBy("run_id").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("cluster_count"), F.avg((F.col("label") < 0).cast("double")).alias("noise"), F.count("*").alias("wallets"))


@query("mixture_grid")
def mixture_grid(spark: SparkSession, d: str) -> DataFrame:
    return X.mixture_grid(_scaled(spark, d, EXPLORED)).withColumnRenamed("smallest", "n")


_LABELS = "la1 AS (SELECT user_id AS wallet, count(*) % 4 AS label FROM events GROUP BY 1), la2 AS (SELECT user_id AS wallet, max(event_id) % 3 AS label FROM events GROUP BY 1), ct AS (SELECT la1.label AS left_label, la2.label AS right_label, count(*) AS n FROM la1 JOIN la2 USING (wallet) GROUP BY 1, 2)"


def _two_labels(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    a = e.groupBy("wallet").agg((F.count("*") % 4).alias("label"))
    return X.contingency(a, e.groupBy("wallet").agg((F.max("tx") % 3).alias("label")))


@query("label_contingency", tidied(f"WITH {_LABELS}\n", "ct", ["left_label", "right_label", "n"]))
def label_contingency(spark: SparkSession, d: str) -> DataFrame:
    return _two_labels(spark, d).select(F.col("left").alias("left_label"), F.col("right").alias("right_label"), "n")


@query("adjusted_rand", f"""WITH {_LABELS}, p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS ab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY left_label)) AS a, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY right_label)) AS b, (SELECT sum(n) FROM ct) AS n)
SELECT round(((ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)))::DOUBLE, 6) AS ari FROM p""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return X.adjusted_rand(_two_labels(spark, d))


@query("effect_sizes", tidied(f"""{_MATRIX},\n{_SCALED},
es_l AS (SELECT DISTINCT wallet, wallet % 4 AS label FROM sv), es AS (SELECT feature, label, scaled FROM sv JOIN es_l USING (wallet)),
es_g AS (SELECT feature, g.label, count(*) FILTER (es.label = g.label) AS n, count(*) FILTER (es.label <> g.label) AS m, avg(scaled) FILTER (es.label = g.label) - avg(scaled) FILTER (es.label <> g.label) AS gap, var_samp(scaled) FILTER (es.label = g.label) AS va, var_samp(scaled) FILTER (es.label <> g.label) AS vb FROM es CROSS JOIN range(0, 4) g(label) GROUP BY 1, 2),
es_r AS (SELECT label AS k, feature, n, CASE WHEN n < 2 OR m < 2 OR ((n - 1) * va + (m - 1) * vb) / (n + m - 2) <= 1e-12 THEN 0.0 ELSE gap / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)) END AS effect FROM es_g WHERE n > 0)
""", "es_r", ["k", "n", "effect"], ("feature",)))
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = _scaled(spark, d)
    labels = s.select("wallet", (F.col("wallet") % 4).alias("label"))
    return X.effect_sizes(s, labels).withColumnRenamed("label", "k")


@query("profile_document")
def profile_document(spark: SparkSession, d: str) -> DataFrame:
    return D.documents(feature_matrix(spark, d))


@query("profile_page")
def profile_page(spark: SparkSession, d: str) -> DataFrame:
    return D.page(D.documents(feature_matrix(spark, d)), 1, 50)
