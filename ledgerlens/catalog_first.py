"""Registered queries of the first version's families and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.catalog import query, tidied
from ledgerlens.operators import first as V
from ledgerlens.operators.rules import join_families
from ledgerlens.plans import first_sql as Q
from ledgerlens.sources.adapters import cell_graph, graph_files, order_stream
from ledgerlens.sources.store import once

TEMPORAL = [
    "wallet", "n_observed_transactions", "interarrival_mean_seconds", "interarrival_median_seconds", "interarrival_std_seconds", "interarrival_cv", "burstiness", "active_hour_entropy", "active_weekday_entropy", "interval_repeat_ratio",
    "dominant_period_seconds", "periodicity_strength", "phase_stability",
]
TOPOLOGY = [
    "wallet", "mean_input_cells_per_tx", "mean_output_cells_per_tx", "max_input_cells_per_tx", "max_output_cells_per_tx", "fanin_transaction_ratio", "fanout_transaction_ratio", "many_to_many_ratio", "cell_fragmentation_ratio",
    "cell_consolidation_ratio", "mean_external_input_locks", "mean_external_output_locks", "topology_entropy", "topology_repeat_ratio",
]
TEMPLATES = ["wallet", "unique_template_count", "dominant_template_ratio", "template_entropy", "template_repeat_ratio", "template_transition_entropy"]
SCRIPTS = ["wallet", "cells_with_full_script_count", "total_cell_count", "full_script_coverage_ratio"]
CAPACITY = ["wallet", "target_input_capacity", "target_output_capacity", "target_net_capacity_delta", "mean_target_input_capacity", "mean_target_output_capacity", "median_abs_target_delta"]
_STATE = ("support_state",)


def _sql(*ctes: str) -> str:
    return Q.BASE.rstrip() + ",\n" + ",\n".join(ctes) + "\n"


@query("first_temporal", tidied(_sql(Q.TEMPORAL), "a_temporal", TEMPORAL, _STATE))
def first_temporal(spark: SparkSession, d: str) -> DataFrame:
    return V.temporal(order_stream(spark, d))


@query("first_topology", tidied(_sql(Q.SHAPES, Q.TOPOLOGY), "a_topology", TOPOLOGY, _STATE))
def first_topology(spark: SparkSession, d: str) -> DataFrame:
    return V.topology(order_stream(spark, d), cell_graph(spark, d))


@query("first_templates", tidied(_sql(Q.SHAPES, Q.TEMPLATES), "a_templates", TEMPLATES, _STATE))
def first_templates(spark: SparkSession, d: str) -> DataFrame:
    return V.templates(V.template_hashes(order_stream(spark, d), cell_graph(spark, d)))


@query("first_scripts", tidied(_sql(Q.SCRIPTS), "a_scripts", SCRIPTS, ("support_state", "script_family_counts")))
def first_scripts(spark: SparkSession, d: str) -> DataFrame:
    return V.scripts(order_stream(spark, d), cell_graph(spark, d))


@query("first_capacity", tidied(_sql(Q.CAPACITY), "a_capacity", CAPACITY, _STATE))
def first_capacity(spark: SparkSession, d: str) -> DataFrame:
    return V.capacity(order_stream(spark, d), cell_graph(spark, d))


def first_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The families that the rules read, one row a wallet."""
    tx, cells = order_stream(spark, d), cell_graph(spark, d)
    plans = {"temporal": lambda: V.temporal(tx), "topology": lambda: V.topology(tx, cells), "templates": lambda: V.templates(V.template_hashes(tx, cells))}
    return join_families({name: once(spark, f"first_{name}", graph_files(d), build, by="wallet", dealt=True) for name, build in plans.items()})


@query("rules_v1", tidied(_sql(Q.MATRIX, Q.RULES), "ar", ["wallet", "score"], ("rule", "support_state", "reasons", "supported")))
def rules_v1(spark: SparkSession, d: str) -> DataFrame:
    return V.evaluate(first_matrix(spark, d))


@query("rule_sensitivity", tidied(_sql(Q.MATRIX, Q.SENSITIVITY), "asn", ["wallet"], ("rule", "metric", "at_low", "at_base", "at_high", "verdict")))
def rule_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return V.sensitivity(first_matrix(spark, d))
