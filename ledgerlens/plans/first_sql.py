"""DuckDB SQL of the first version's families and rules, written apart from the DataFrame plans to check them."""

from __future__ import annotations

from ledgerlens.plans.sql import CELLS, LOCK_FAMILY, ORDERS, TYPE_FAMILY, cv, normalized, with_

BITS = "-sum(c / t * log2(c / t))"


def _gate(state: str, least: int, values: dict[str, str], source: str) -> str:
    own = f"CASE WHEN n < {least} THEN 'INSUFFICIENT_EVIDENCE' ELSE {state} END"
    cols = ", ".join(f"CASE WHEN support_state <> 'INSUFFICIENT_EVIDENCE' THEN {v} END AS {k}" for k, v in values.items())
    return f"SELECT wallet, support_state, {cols} FROM (SELECT *, {own} AS support_state FROM {source})"


TEMPORAL = f"""v1g AS (SELECT wallet, ts, CASE WHEN ts - lag(ts) OVER w > 0 THEN ts - lag(ts) OVER w END AS gap FROM otx WINDOW w AS (PARTITION BY wallet ORDER BY ts, idx, tx)),
v1b AS (SELECT wallet, count(*) AS n, count(gap) AS g, avg(gap) AS mean, median(gap) AS med, stddev_pop(gap) AS std, {cv('gap')} AS cv, min(ts) AS t0 FROM v1g GROUP BY wallet),
v1s AS (SELECT wallet, median(abs(gap - med)) AS mad, count(*) FILTER (abs(gap - med) <= greatest(1.0, 0.05 * med)) / nullif(count(gap), 0) AS again,
  sqrt(sum(cos(2 * pi() * ((ts - t0) % med) / med)) ** 2 + sum(sin(2 * pi() * ((ts - t0) % med) / med)) ** 2) / count(*) AS phase FROM v1g JOIN v1b USING (wallet) GROUP BY wallet),
v1h AS (SELECT wallet, -sum(c / t * log2(c / t)) / log2(24) AS hours FROM (SELECT wallet, count(*) AS c, sum(count(*)) OVER (PARTITION BY wallet) AS t FROM otx GROUP BY wallet, (ts // 3600) % 24) GROUP BY wallet),
v1w AS (SELECT wallet, -sum(c / t * log2(c / t)) / log2(7) AS days FROM (SELECT wallet, count(*) AS c, sum(count(*)) OVER (PARTITION BY wallet) AS t FROM otx GROUP BY wallet, (ts // 86400 + 4) % 7) GROUP BY wallet),
v1t AS (SELECT * REPLACE (CASE WHEN g < 4 THEN 0 ELSE n END AS n), n AS every FROM v1b JOIN v1s USING (wallet) JOIN v1h USING (wallet) JOIN v1w USING (wallet)),
a_temporal AS ({_gate("'SUPPORTED'", 5, {
    "n_observed_transactions": "every", "interarrival_mean_seconds": "mean", "interarrival_median_seconds": "med", "interarrival_std_seconds": "std", "interarrival_cv": "cv", "burstiness": "(std - mean) / nullif(std + mean, 0)",
    "active_hour_entropy": "hours", "active_weekday_entropy": "days", "interval_repeat_ratio": "again", "dominant_period_seconds": "CASE WHEN every >= 8 THEN med END",
    "periodicity_strength": "CASE WHEN every >= 8 THEN exp(-mad / med) END", "phase_stability": "CASE WHEN every >= 8 THEN phase END"}, "v1t")})"""

SHAPES = """v1x AS (SELECT wallet, tx, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, count(*) FILTER (side = 'in' AND target) AS ti, count(*) FILTER (side = 'out' AND target) AS tout,
  count(DISTINCT lock) FILTER (side = 'in') AS li, count(DISTINCT lock) FILTER (side = 'out') AS lo, count(DISTINCT lock) FILTER (side = 'in' AND target) AS oi, count(DISTINCT lock) FILTER (side = 'out' AND target) AS oo FROM cells GROUP BY wallet, tx),
v1y AS (SELECT wallet, tx, ts, idx, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(ti, 0) AS ti, coalesce(tout, 0) AS tout, coalesce(li, 0) AS li, coalesce(lo, 0) AS lo, coalesce(li - oi, 0) AS ei, coalesce(lo - oo, 0) AS eo
  FROM otx LEFT JOIN v1x USING (wallet, tx))"""

TOPOLOGY = f"""v1c AS (SELECT wallet, count(*) AS c, sum(count(*)) OVER (PARTITION BY wallet) AS t FROM v1y GROUP BY wallet, i, o, li, lo, ti > 0, tout > 0),
v1e AS (SELECT wallet, {normalized()} AS entropy, max(c) / sum(c) AS top FROM v1c GROUP BY wallet),
v1p AS (SELECT wallet, count(*) AS n, avg(i) AS mi, avg(o) AS mo, max(i) AS xi, max(o) AS xo, count(*) FILTER (tout > 0 AND li > 1) / count(*) AS fi, count(*) FILTER (ti > 0 AND lo > 1) / count(*) AS fo,
  count(*) FILTER (li > 1 AND lo > 1) / count(*) AS mm, count(*) FILTER (ti > 0 AND o > i) / count(*) AS fr, count(*) FILTER (tout > 0 AND i > o) / count(*) AS co, avg(ei) AS aei, avg(eo) AS aeo FROM v1y GROUP BY wallet),
v1q AS (SELECT * FROM v1p JOIN v1e USING (wallet)),
a_topology AS ({_gate("'SUPPORTED'", 3, {
    "mean_input_cells_per_tx": "mi", "mean_output_cells_per_tx": "mo", "max_input_cells_per_tx": "xi", "max_output_cells_per_tx": "xo", "fanin_transaction_ratio": "fi", "fanout_transaction_ratio": "fo", "many_to_many_ratio": "mm",
    "cell_fragmentation_ratio": "fr", "cell_consolidation_ratio": "co", "mean_external_input_locks": "aei", "mean_external_output_locks": "aeo", "topology_entropy": "entropy", "topology_repeat_ratio": "top"}, "v1q")})"""

_LOCK = f"CASE WHEN lock % 5 <= 3 THEN {LOCK_FAMILY} ELSE lock::VARCHAR END"
_TYPE = f"CASE WHEN type IN ('A', 'R') THEN {TYPE_FAMILY} ELSE coalesce(type, 'UNKNOWN') END"
TEMPLATES = f"""v1k AS (SELECT wallet, tx, side || ':' || {_LOCK} || ':' || {_TYPE} || ':' || CASE WHEN asset IS NOT NULL THEN '16' ELSE '0' END AS one,
  side || '=' || round_even(100 * capacity / nullif(sum(capacity) OVER (PARTITION BY wallet, tx, side), 0), 0)::INT AS share FROM cells),
v1l AS (SELECT wallet, tx, array_to_string(list_sort(list(one)), ',') AS ones, array_to_string(list_sort(list(share)), ',') AS shares FROM v1k GROUP BY wallet, tx),
v1m AS (SELECT wallet, tx, ts, idx, concat_ws('|', i, o, ti > 0, tout > 0, coalesce(ones, ''), coalesce(shares, '')) AS template FROM v1y LEFT JOIN v1l USING (wallet, tx)),
v1n AS (SELECT wallet, template, count(*) AS c, sum(count(*)) OVER (PARTITION BY wallet) AS t FROM v1m GROUP BY wallet, template),
v1o AS (SELECT wallet, max(t) AS n, count(*) AS kinds, max(c) AS top, {BITS} AS entropy, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS again FROM v1n GROUP BY wallet),
v1u AS (SELECT wallet, template, lead(template) OVER (PARTITION BY wallet ORDER BY ts, idx, tx) AS after FROM v1m),
v1v AS (SELECT wallet, {BITS} AS steps FROM (SELECT wallet, count(*) AS c, sum(count(*)) OVER (PARTITION BY wallet) AS t FROM v1u WHERE after IS NOT NULL GROUP BY wallet, template, after) GROUP BY wallet),
v1z AS (SELECT * FROM v1o LEFT JOIN v1v USING (wallet)),
a_templates AS ({_gate("'SUPPORTED'", 3, {"unique_template_count": "kinds", "dominant_template_ratio": "top / n", "template_entropy": "entropy", "template_repeat_ratio": "again / n", "template_transition_entropy": "coalesce(steps, 0.0)"}, "v1z")})"""

SCRIPTS = f"""v1f AS (SELECT wallet, {LOCK_FAMILY} AS family FROM cells WHERE lock IS NOT NULL UNION ALL SELECT wallet, {TYPE_FAMILY} FROM cells WHERE type IS NOT NULL),
v1fc AS (SELECT wallet, family, count(*) AS c FROM v1f GROUP BY wallet, family),
v1ft AS (SELECT wallet, array_to_string(list_sort(list(family || '=' || c)), ',') AS told, sum(c) AS known FROM v1fc GROUP BY wallet),
v1fn AS (SELECT wallet, n, told, coalesce(known, 0) AS known, coalesce(k, 0) AS k FROM (SELECT wallet, count(*) AS n FROM otx GROUP BY wallet) LEFT JOIN (SELECT wallet, count(*) AS k FROM cells GROUP BY wallet) USING (wallet) LEFT JOIN v1ft USING (wallet)),
a_scripts AS ({_gate("CASE WHEN known = 0 THEN 'PARTIAL' ELSE 'SUPPORTED' END", 1, {"script_family_counts": "coalesce(told, '')", "cells_with_full_script_count": "known", "total_cell_count": "k", "full_script_coverage_ratio": "known / nullif(k, 0)"}, "v1fn")})"""

CAPACITY = f"""v1a AS (SELECT wallet, tx, coalesce(sum(capacity) FILTER (side = 'in' AND target), 0) AS i, coalesce(sum(capacity) FILTER (side = 'out' AND target), 0) AS o FROM cells GROUP BY wallet, tx),
v1aa AS (SELECT wallet, count(*) AS n, sum(coalesce(i, 0)) AS si, sum(coalesce(o, 0)) AS so, avg(coalesce(i, 0)) AS mi, avg(coalesce(o, 0)) AS mo, median(abs(coalesce(o, 0) - coalesce(i, 0))) AS md FROM otx LEFT JOIN v1a USING (wallet, tx) GROUP BY wallet),
a_capacity AS ({_gate("'SUPPORTED'", 1, {
    "target_input_capacity": "si", "target_output_capacity": "so", "target_net_capacity_delta": "so - si", "mean_target_input_capacity": "mi", "mean_target_output_capacity": "mo", "median_abs_target_delta": "md"}, "v1aa")})"""

WIDE = "aw AS (SELECT t.wallet, " + ", ".join(
    f"t.{c} AS t_{c}" for c in ("support_state", "periodicity_strength", "phase_stability", "interarrival_cv")
) + ", p.support_state AS p_state, p.* EXCLUDE (wallet, support_state), m.support_state AS m_state, m.template_repeat_ratio AS m_repeat FROM a_temporal t JOIN a_topology p USING (wallet) JOIN a_templates m USING (wallet))"

#: Checks of each rule as (column of WIDE, direction, cutoff, reason), the test for missing evidence and for full support.
CHECKS = {
    "PERIODIC_EXECUTION": ((("t_periodicity_strength", 1, 0.8, "STRONG_PERIODICITY"), ("t_phase_stability", 1, 0.75, "STABLE_PHASE"), ("t_interarrival_cv", -1, 0.35, "LOW_INTERVAL_VARIABILITY")), "t_support_state = 'INSUFFICIENT_EVIDENCE' OR t_periodicity_strength IS NULL", "TEMPORAL"),
    "BATCH_DISTRIBUTION": ((("fanout_transaction_ratio", 1, 0.5, "REPEATED_FAN_OUT_STRUCTURE"), ("mean_external_output_locks", 1, 2.0, "MANY_EXTERNAL_OUTPUT_LOCKS"), ("m_repeat", 1, 0.5, "REPEATED_TRANSACTION_TEMPLATE")), "p_state = 'INSUFFICIENT_EVIDENCE'", "TOPOLOGY"),
    "FAN_IN_COLLECTION": ((("fanin_transaction_ratio", 1, 0.5, "REPEATED_FAN_IN_STRUCTURE"), ("mean_external_input_locks", 1, 2.0, "MANY_EXTERNAL_INPUT_LOCKS"), ("topology_repeat_ratio", 1, 0.5, "REPEATED_TOPOLOGY")), "p_state = 'INSUFFICIENT_EVIDENCE'", "TOPOLOGY"),
}


def _pass(column: str, way: int, cutoff: float) -> str:
    return f"coalesce({column} {'>=' if way > 0 else '<='} {cutoff!r}::DOUBLE, false)"


def _rule(name: str) -> str:
    checks, missing, family = CHECKS[name]
    passed = [_pass(c, way, cut) for c, way, cut, _ in checks]
    score = "(" + " + ".join(f"({p})::INT" for p in passed) + ")"
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{r}' END" for p, (*_, r) in zip(passed, checks, strict=True)) + ")"
    return (
        f"SELECT wallet, '{name}' AS rule, CASE WHEN {missing} THEN 'INSUFFICIENT_EVIDENCE' WHEN {score} = 3 THEN 'SUPPORTED' ELSE 'PARTIAL' END AS support_state, CASE WHEN NOT ({missing}) THEN {score} / 3 END AS score, "
        f"CASE WHEN {missing} THEN 'INSUFFICIENT_{family}_SUPPORT' ELSE {reasons} END AS reasons, NOT ({missing}) AND {score} = 3 AS supported FROM aw"
    )


def _sensitivity(name: str) -> str:
    checks = CHECKS[name][0]
    shown = {"m_repeat": "template_repeat_ratio"}

    def decide(moved: set[str], factor: float) -> str:
        return "(" + " AND ".join(_pass(c, way, cut * (factor if c in moved else 1.0)) for c, way, cut, _ in checks) + ")"

    def stable(c: str) -> str:
        low, base, high = (decide({c}, f) for f in (0.8, 1.0, 1.2))
        return f"({low} = {base} AND {base} = {high})"

    rows = [("ALL", {c for c, *_ in checks}, " AND ".join(stable(c) for c, *_ in checks))] + [(c, {c}, stable(c)) for c, *_ in checks]
    return " UNION ALL ".join(
        f"SELECT wallet, '{name}' AS rule, '{shown.get(m, m).removeprefix('t_')}' AS metric, {decide(moved, 0.8)} AS at_low, {decide(moved, 1.0)} AS at_base, {decide(moved, 1.2)} AS at_high, CASE WHEN {ok} THEN 'stable' ELSE 'threshold-sensitive' END AS verdict FROM aw"
        for m, moved, ok in rows
    )


BASE = with_(ORDERS, CELLS)
MATRIX = ",\n".join([TEMPORAL, SHAPES, TOPOLOGY, TEMPLATES, WIDE])
RULES = "ar AS (" + " UNION ALL ".join(map(_rule, CHECKS)) + ")"
SENSITIVITY = "asn AS (" + " UNION ALL ".join(map(_sensitivity, CHECKS)) + ")"
