"""DuckDB SQL of the feature families, written apart from the DataFrame plans to check them.

Every family is a chain of common table expressions that ends in f_<family>(wallet, support_state, values...).
"""

from __future__ import annotations

EVENTS = "ev AS (SELECT user_id AS wallet, event_id AS tx, floor(epoch(ts))::BIGINT AS ts, event_id AS idx, event_type AS token, props FROM events)"
ORDERS = """otx AS (SELECT *, lag(tx) OVER w AS prev_tx, lag(ts) OVER w AS prev_ts FROM
  (SELECT o_custkey AS wallet, o_orderkey AS tx, floor(epoch(o_orderdate))::BIGINT AS ts, o_orderkey AS idx FROM orders) WINDOW w AS (PARTITION BY wallet ORDER BY ts, tx))"""
CELLS = """made AS (SELECT l_orderkey AS made, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos,
  round(l_extendedprice * 100)::BIGINT AS capacity, round(l_quantity * 100)::BIGINT AS occupied, l_suppkey AS lock, l_returnflag AS type, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS asset FROM lineitem),
cells AS MATERIALIZED (SELECT wallet, tx, ts, idx, 'out' AS side, pos, capacity, occupied, lock, type, asset, lock % 4 = wallet % 4 AS target, NULL::BIGINT AS prev_tx, NULL::BIGINT AS prev_pos, NULL::BIGINT AS prev_ts FROM otx JOIN made ON tx = made
  UNION ALL SELECT wallet, tx, ts, idx, 'in', pos, capacity, occupied, lock, type, asset, lock % 4 = wallet % 4, prev_tx, pos, prev_ts FROM otx JOIN made ON prev_tx = made)"""


def entropy(counts: list[str], alphabet: int | None = None) -> str:
    total = f"nullif(({' + '.join(counts)}), 0)"
    bits = " + ".join(f"CASE WHEN {c} > 0 THEN ({c}) / {total} * log2(({c}) / {total}) ELSE 0 END" for c in counts)
    return f"(-({bits}) / {f'log2({alphabet})' if alphabet else '1'} + 0 * {total})"


def normalized(c: str = "c", t: str = "t") -> str:
    return f"CASE WHEN count({c}) > 1 THEN -sum({c} / {t} * log2({c} / {t})) / log2(count({c})) WHEN count({c}) = 1 THEN 0.0 END"


def cv(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 THEN stddev_pop({x}) / nullif(avg({x}), 0) END"


def duration_entropy(x: str) -> str:
    ends = [-1, 60, 300, 3600, 21600, 86400, 604800]
    bins = [f"count(*) FILTER ({x} > {a} AND {x} <= {b})" for a, b in zip(ends, ends[1:])] + [f"count(*) FILTER ({x} > 604800)"]
    return entropy(bins, 7)


def state(family: str, small: str, partial: str = "false") -> str:
    return f"CASE WHEN coalesce({small}, true) THEN 'INSUFFICIENT_EVIDENCE' WHEN {partial} THEN 'PARTIAL' ELSE 'SUPPORTED' END"


def gate(source: str, stated: str, values: dict[str, str], digits: int | None = None) -> str:
    cols = ", ".join(f"CASE WHEN support_state IN ('SUPPORTED', 'PARTIAL') THEN {v} END AS {k}" for k, v in values.items())
    return f"SELECT wallet, support_state, {cols} FROM (SELECT *, {stated} AS support_state FROM {source})"


def clusters(name: str, source: str, value: str) -> str:
    """name(wallet, cid, size, median) of tolerant clusters of the values of a source."""
    m = "list_aggregate(cur, 'median')"
    near = f"abs(s.v - {m}) <= greatest(1.0, 0.05 * abs({m}))"
    return f"""{name}_s AS (SELECT wallet, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY wallet ORDER BY {value}) AS i FROM {source} WHERE {value} IS NOT NULL),
{name}_r AS (SELECT wallet, i, [v] AS cur, 1 AS cid FROM {name}_s WHERE i = 1 UNION ALL
  SELECT s.wallet, s.i, CASE WHEN {near} THEN list_append(cur, s.v) ELSE [s.v] END, CASE WHEN {near} THEN cid ELSE cid + 1 END FROM {name}_r r JOIN {name}_s s ON s.wallet = r.wallet AND s.i = r.i + 1),
{name} AS (SELECT wallet, cid, max(len(cur)) AS size, arg_max({m}, len(cur)) AS median FROM {name}_r GROUP BY wallet, cid)"""


def transitions(name: str, source: str, value: str) -> str:
    return f"""{name}_p AS (SELECT wallet, {value} AS a, lead({value}) OVER (PARTITION BY wallet ORDER BY ts, idx, tx) AS b, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, idx DESC, tx DESC) AS back FROM {source}),
{name}_c AS (SELECT *, sum(c) OVER (PARTITION BY wallet) AS t FROM (SELECT wallet, a, b, count(*) AS c FROM {name}_p WHERE back > 1 GROUP BY wallet, a, b)),
{name} AS (SELECT wallet, {normalized()} AS transition_entropy, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS transition_repeat_ratio, sum(CASE WHEN a = b THEN c ELSE 0 END) / sum(c) AS consecutive_repeat_ratio FROM {name}_c GROUP BY wallet)"""


def gap_table(tx: str) -> str:
    return f"""g0 AS (SELECT wallet, tx, ts, idx, ts - lag(ts) OVER w AS since FROM {tx} WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY wallet ORDER BY ts, coalesce(idx, 0), tx)),
g1 AS (SELECT *, CASE WHEN since > 0 THEN since END AS gap, sum(CASE WHEN since <= 1800 THEN 0 ELSE 1 END) OVER w AS r1800, sum(CASE WHEN since <= 60 THEN 0 ELSE 1 END) OVER w AS r60 FROM g0 WINDOW w AS (PARTITION BY wallet ORDER BY ts, coalesce(idx, 0), tx)),
g2 AS (SELECT *, avg(gap) OVER (PARTITION BY wallet) AS gm FROM g1),
s1 AS (SELECT wallet, r1800 AS run, count(*) AS n, max(ts) - min(ts) AS duration, min(ts) AS started FROM g1 GROUP BY ALL),
b1 AS (SELECT wallet, r60 AS run, count(*) AS n, max(ts) - min(ts) AS duration, min(ts) AS started FROM g1 GROUP BY ALL HAVING count(*) >= 3)"""


def temporal(tx: str) -> str:
    hours = [f"count(*) FILTER ((ts // 3600) % 24 = {h})" for h in range(24)]
    days = [f"count(*) FILTER ((ts // 86400 + 4) % 7 = {d})" for d in range(7)]
    moment = lambda k: f"sum(power(gap - gm, {k})) / count(gap) / nullif(power(stddev_pop(gap), {k}), 0)"
    q = {k: f"quantile_cont(gap, {p})" for k, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))}
    values = {
        "transaction_count": "n", "positive_gap_count": "g", "interarrival_mean": "mean", "interarrival_median": "p50", "interarrival_std": "std", "interarrival_cv": "cv", "interarrival_p10": "p10", "interarrival_p25": "p25",
        "interarrival_p75": "p75", "interarrival_p90": "p90", "interarrival_skewness": "skew", "interarrival_kurtosis": "kurt", "gap_entropy": "bins", "activity_session_count": "sn", "mean_session_duration": "sd",
        "median_session_duration": "sm", "mean_transactions_per_session": "st", "max_transactions_per_session": "sx", "burst_count": "coalesce(bn, 0)", "mean_burst_size": "coalesce(bs, 0.0)", "max_burst_size": "coalesce(bx, 0)",
        "mean_burst_duration": "coalesce(bd, 0.0)", "transactions_in_bursts_ratio": "coalesce(bt, 0) / n", "hour_of_day_entropy": "hour", "weekday_entropy": "day", "active_hour_concentration": "top_hour / n", "active_day_concentration": "top_day / n",
    }
    return f"""tb AS (SELECT wallet, count(*) AS n, count(gap) AS g, avg(gap) AS mean, {', '.join(f'{v} AS {k}' for k, v in q.items())}, stddev_pop(gap) AS std, {cv('gap')} AS cv,
  CASE WHEN count(gap) >= 3 THEN coalesce({moment(3)}, 0.0) END AS skew, CASE WHEN count(gap) >= 4 THEN coalesce({moment(4)} - 3, 0.0) END AS kurt, {duration_entropy('gap')} AS bins,
  {entropy(hours, 24)} AS hour, {entropy(days, 7)} AS day, greatest({', '.join(hours)}) AS top_hour, greatest({', '.join(days)}) AS top_day FROM g2 GROUP BY wallet),
ts1 AS (SELECT wallet, count(*) AS sn, avg(duration) AS sd, median(duration) AS sm, avg(n) AS st, max(n) AS sx FROM s1 GROUP BY wallet),
tb1 AS (SELECT wallet, count(*) AS bn, avg(n) AS bs, max(n) AS bx, avg(duration) AS bd, sum(n) AS bt FROM b1 GROUP BY wallet),
tj AS (SELECT * FROM tb LEFT JOIN ts1 USING (wallet) LEFT JOIN tb1 USING (wallet)),
f_temporal AS ({gate('tj', state('temporal', 'n < 5 OR g < 4'), values)})"""


def autocorrelation() -> str:
    return """ac0 AS (SELECT wallet, gap::DOUBLE AS x, row_number() OVER (PARTITION BY wallet ORDER BY ts, coalesce(idx, 0), tx) AS i, count(*) OVER (PARTITION BY wallet) AS n FROM g1 WHERE gap IS NOT NULL),
ac AS (SELECT wallet, lag, CASE WHEN count(*) >= 2 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS r FROM
  (SELECT a.wallet, b.i - a.i AS lag, a.x, b.x AS y FROM ac0 a JOIN ac0 b ON a.wallet = b.wallet AND b.i > a.i AND b.i - a.i <= greatest(1, least(50, a.n // 2))) GROUP BY wallet, lag)"""


def weekly(tx: str, start: int) -> str:
    return f"""w0 AS (SELECT wallet, (ts - {start}) // 604800 AS week, ts - lag(ts) OVER (PARTITION BY wallet, (ts - {start}) // 604800 ORDER BY ts, coalesce(idx, 0), tx) AS gap FROM {tx} WHERE ts >= {start} AND (ts - {start}) // 604800 < 4),
wk AS (SELECT wallet, week, count(*) AS gaps, median(gap) AS median FROM w0 WHERE gap > 0 GROUP BY wallet, week)"""


def periodicity(tx: str, start: int) -> str:
    values = {
        "dominant_period_seconds": "period", "periodicity_strength": "exp(-mad / nullif(period, 0))", "phase_stability": "phase", "autocorrelation_peak_strength": "peak", "autocorrelation_peak_lag": "peak_lag",
        "interval_cluster_concentration": "csize / g", "dominant_interval_cluster": "cmed", "dominant_interval_cluster_ratio": "csize / g", "multi_period_candidate_count": "coalesce(multi, 0)", "eligible_subwindow_count": "coalesce(eligible, 0)",
        "period_presence_count": "coalesce(present, 0)", "period_stability_score": "CASE WHEN eligible >= 2 THEN present / eligible / (1 + coalesce(wcv, 0)) END", "spectral_power": "NULL::DOUBLE", "spectral_peak_ratio": "NULL::DOUBLE",
    }
    here = "abs(median - period) <= greatest(1.0, 0.1 * period)"
    return f"""{autocorrelation()},
{weekly(tx, start)},
{clusters('pc', 'g1', 'gap')},
pm AS (SELECT wallet, count(*) AS n, count(gap) AS g, median(gap) AS period, min(ts) AS t0 FROM g1 GROUP BY wallet),
ps AS (SELECT wallet, median(abs(gap - period)) AS mad, sqrt(power(sum(cos(2 * pi() * ((ts - t0) % period) / period)), 2) + power(sum(sin(2 * pi() * ((ts - t0) % period) / period)), 2)) / count(*) AS phase FROM g1 JOIN pm USING (wallet) GROUP BY wallet),
pa AS (SELECT wallet, r AS peak, lag AS peak_lag FROM ac WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY round(r, 9) DESC, lag) = 1),
pt AS (SELECT wallet, size AS csize, median AS cmed FROM pc QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY size DESC, median) = 1),
pq AS (SELECT wallet, count(*) FILTER (size >= 2) AS multi FROM pc GROUP BY wallet),
pw AS (SELECT wallet, count(*) AS eligible, count(*) FILTER ({here}) AS present, {cv(f'(CASE WHEN {here} THEN median END)')} AS wcv FROM wk JOIN pm USING (wallet) WHERE gaps >= 3 GROUP BY wallet),
pj AS (SELECT * FROM pm LEFT JOIN ps USING (wallet) LEFT JOIN pa USING (wallet) LEFT JOIN pt USING (wallet) LEFT JOIN pq USING (wallet) LEFT JOIN pw USING (wallet)),
f_periodicity AS ({gate('pj', state('periodicity', 'n < 8 OR g < 7'), values)})"""


SHAPES = """sh0 AS (SELECT wallet, tx, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, count(*) FILTER (side = 'in' AND target) AS ti, count(*) FILTER (side = 'out' AND target) AS to_,
  list(DISTINCT lock) FILTER (side = 'in') AS li, list(DISTINCT lock) FILTER (side = 'out') AS lo, list(DISTINCT lock) FILTER (target) AS lt FROM cells GROUP BY wallet, tx),
sh AS (SELECT t.wallet, t.tx, t.ts, t.idx, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(ti, 0) AS ti, coalesce(to_, 0) AS to_,
  CASE WHEN i = 1 AND o = 1 THEN '1_TO_1' WHEN i = 1 AND o > 1 THEN '1_TO_N' WHEN i > 1 AND o = 1 THEN 'N_TO_1' WHEN i > 1 AND o > 1 THEN 'N_TO_N' ELSE 'OTHER' END AS topology,
  len(list_filter(coalesce(li, []), lambda x: NOT list_contains(coalesce(lt, []), x)))::BIGINT AS external_in, len(list_filter(coalesce(lo, []), lambda x: NOT list_contains(coalesce(lt, []), x)))::BIGINT AS external_out
  FROM otx t LEFT JOIN sh0 USING (wallet, tx))"""


def topology() -> str:
    kinds = ("1_TO_1", "1_TO_N", "N_TO_1", "N_TO_N", "OTHER")
    n = [f"count(*) FILTER (topology = '{k}')" for k in kinds]
    some = " + ".join(f"({x} > 0)::INT" for x in n)
    fr, co = "ti > 0 AND to_ > ti", "to_ > 0 AND ti > to_"
    values = {
        "one_to_one_ratio": "k0", "one_to_many_ratio": "k1", "many_to_one_ratio": "k2", "many_to_many_ratio": "k3", "other_ratio": "k4", "dominant_topology": "dominant", "dominant_topology_ratio": "greatest(k0, k1, k2, k3, k4)",
        "input_cell_count_mean": "im", "input_cell_count_median": "id", "input_cell_count_cv": "ic", "output_cell_count_mean": "om", "output_cell_count_median": "od", "output_cell_count_cv": "oc",
        "external_input_lock_mean": "ei", "external_output_lock_mean": "eo", "topology_entropy": "entropy", "topology_repeat_ratio": "greatest(k0, k1, k2, k3, k4)", "topology_transition_entropy": "transition_entropy",
        "fragmentation_event_count": "fn", "fragmentation_event_ratio": "fn / n", "mean_fragmentation_factor": "coalesce(fm, 0.0)", "max_fragmentation_factor": "coalesce(fx, 0.0)",
        "consolidation_event_count": "cn", "consolidation_event_ratio": "cn / n", "mean_consolidation_factor": "coalesce(cm, 0.0)", "max_consolidation_factor": "coalesce(cx, 0.0)",
    }
    return f"""{transitions('tt', 'sh', 'topology')},
td AS (SELECT wallet, topology AS dominant FROM (SELECT wallet, topology, count(*) AS c, min({{'a': ts, 'b': idx, 'c': tx}}) AS seen FROM sh GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY c DESC, seen) = 1),
ta AS (SELECT wallet, count(*) AS n, {', '.join(f'{x} / count(*) AS k{j}' for j, x in enumerate(n))}, avg(i) AS im, median(i) AS id, {cv('i')} AS ic, avg(o) AS om, median(o) AS od, {cv('o')} AS oc, avg(external_in) AS ei, avg(external_out) AS eo,
  CASE WHEN {some} > 1 THEN {entropy(n)} / log2({some}) WHEN {some} = 1 THEN 0.0 END AS entropy,
  count(*) FILTER ({fr}) AS fn, avg(to_ / ti) FILTER ({fr}) AS fm, max(to_ / ti) FILTER ({fr}) AS fx, count(*) FILTER ({co}) AS cn, avg(ti / to_) FILTER ({co}) AS cm, max(ti / to_) FILTER ({co}) AS cx FROM sh GROUP BY wallet),
toj AS (SELECT * FROM ta JOIN td USING (wallet) LEFT JOIN tt USING (wallet)),
f_topology AS ({gate('toj', state('topology', 'n < 3'), values)})"""


def capacity() -> str:
    s = {a: f"(CASE WHEN side = '{a}' THEN capacity END)" for a in ("in", "out")}
    name = {"in": "input", "out": "output"}
    values = {f"{name[a]}_capacity_{k}": f"{a}_{k}" for a in s for k in ("mean", "median", "cv")} | {
        "capacity_repeat_ratio": "repeat_", "capacity_input_entropy": "ein", "capacity_output_entropy": "eout", "target_created_capacity": "created", "target_consumed_capacity": "consumed", "target_net_capacity_delta": "created - consumed",
        "occupied_capacity_total": "occ", "excess_capacity_total": "every - occ",
    }
    return f"""ca AS (SELECT wallet, count(*) AS n, {', '.join(f'avg({x}) AS {a}_mean, median({x}) AS {a}_median, {cv(x)} AS {a}_cv' for a, x in s.items())}, coalesce(sum({s['out']}), 0)::BIGINT AS created, coalesce(sum({s['in']}), 0)::BIGINT AS consumed,
  sum(occupied)::BIGINT AS occ, sum(capacity)::BIGINT AS every, bool_and(side = 'in' OR occupied <= capacity) AS complete FROM cells WHERE target GROUP BY wallet),
cr AS (SELECT wallet, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS repeat_ FROM (SELECT wallet, capacity, count(*) AS c FROM cells WHERE target GROUP BY ALL) GROUP BY wallet),
ce0 AS (SELECT *, sum(c) OVER (PARTITION BY wallet, side) AS t FROM (SELECT wallet, side, capacity, count(*) AS c FROM cells WHERE target GROUP BY ALL)),
ce AS (SELECT wallet, {normalized("(CASE WHEN side = 'in' THEN c END)")} AS ein, {normalized("(CASE WHEN side = 'out' THEN c END)")} AS eout FROM ce0 GROUP BY wallet),
cj AS (SELECT * FROM ca JOIN cr USING (wallet) JOIN ce USING (wallet)),
f_capacity AS ({gate('cj', state('capacity', 'n < 1', 'NOT complete'), values)})"""


LOCK_FAMILY = "CASE lock % 5 WHEN 0 THEN 'F0' WHEN 1 THEN 'F1' WHEN 2 THEN 'F2' WHEN 3 THEN 'F3' ELSE 'UNKNOWN' END"
TYPE_FAMILY = "CASE type WHEN 'A' THEN 'TA' WHEN 'R' THEN 'TR' ELSE 'UNKNOWN' END"


def scripts() -> str:
    def kind(family: str, p: str) -> str:
        return f"""k{p} AS (SELECT wallet, count(*) FILTER (f <> 'UNKNOWN') AS {p}n, {normalized()} AS {p}e, max(c) / sum(c) AS {p}d, sum(CASE WHEN f = 'UNKNOWN' THEN c ELSE 0 END) / sum(c) AS {p}u
  FROM (SELECT *, sum(c) OVER (PARTITION BY wallet) AS t FROM (SELECT wallet, {family} AS f, count(*) AS c FROM sn GROUP BY ALL)) GROUP BY wallet)"""

    values = {
        "unique_lock_script_count": "ul", "unique_type_script_count": "ut", "lock_family_count": "ln", "type_family_count": "tn", "lock_family_entropy": "le", "type_family_entropy": "te", "dominant_lock_family_ratio": "ld",
        "dominant_type_family_ratio": "td", "unknown_lock_ratio": "lu", "unknown_type_ratio": "tu", "script_repeat_ratio": "1 - (ul + ut) / slots", "script_transition_entropy": "transition_entropy", "script_coverage": "slots / (2 * n)",
    }
    return f"""sn AS (SELECT *, {LOCK_FAMILY} AS lf, {TYPE_FAMILY} AS tf FROM cells),
{kind('lf', 'l')},
{kind('tf', 't')},
sa AS (SELECT wallet, count(*) AS n, count(DISTINCT lock) AS ul, count(DISTINCT type) AS ut, count(lock) + count(type) AS slots FROM sn GROUP BY wallet),
st AS (SELECT wallet, tx, min(ts) AS ts, min(idx) AS idx, string_agg(lf || '/' || tf, ',' ORDER BY CASE WHEN side = 'in' THEN 0 ELSE 1 END, pos, lf, tf) AS token FROM sn GROUP BY wallet, tx),
{transitions('sx', 'st', 'token')},
sj AS (SELECT * FROM sa JOIN kl USING (wallet) JOIN kt USING (wallet) LEFT JOIN sx USING (wallet)),
f_scripts AS ({gate('sj', state('scripts', 'n < 1', 'slots <> 2 * n'), values)})"""


def typed_assets() -> str:
    values = {
        "typed_asset_count": "k", "asset_diversity": "kinds", "typed_cell_ratio": "k / n", "token_input_total": "si", "token_output_total": "so", "net_token_delta": "so - si", "token_turnover": "so + si",
        "repeated_token_amount_ratio": "repeat_", "token_amount_entropy": "entropy", "token_fanout_ratio": "fanout", "token_fanin_ratio": "fanin",
    }
    gated = gate("yj", "CASE WHEN k >= 3 THEN 'SUPPORTED' WHEN k > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT_EVIDENCE' END", {k: f"CASE WHEN k >= 3 THEN {v} END" for k, v in values.items()})
    return f"""ya AS (SELECT wallet, count(*) AS n, count(asset) AS k, count(DISTINCT CASE WHEN asset IS NOT NULL THEN type END) AS kinds, coalesce(sum(asset) FILTER (side = 'in'), 0)::BIGINT AS si, coalesce(sum(asset) FILTER (side = 'out'), 0)::BIGINT AS so FROM cells GROUP BY wallet),
yr AS (SELECT wallet, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS repeat_, {normalized()} AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY wallet) AS t FROM (SELECT wallet, asset, count(*) AS c FROM cells WHERE asset IS NOT NULL GROUP BY ALL)) GROUP BY wallet),
yf AS (SELECT wallet, count(*) FILTER (o > i) / count(*) AS fanout, count(*) FILTER (i > o) / count(*) AS fanin FROM (SELECT wallet, tx, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o FROM cells WHERE asset IS NOT NULL GROUP BY ALL) GROUP BY wallet),
yj AS (SELECT * FROM ya LEFT JOIN yr USING (wallet) LEFT JOIN yf USING (wallet)),
f_typed_assets AS ({gated})"""


CENSORED = "cens AS (SELECT wallet, tx, pos FROM cells WHERE side = 'out' AND target EXCEPT ALL SELECT wallet, prev_tx, prev_pos FROM cells WHERE side = 'in' AND target)"


def lifecycle() -> str:
    values = {
        "observed_cell_count": "coalesce(observed, 0)", "consumed_cell_count": "k", "right_censored_cell_count": "coalesce(censored, 0)", "mean_lifetime_seconds": "mean", "median_lifetime_seconds": "p50", "lifetime_std": "std", "lifetime_cv": "cv",
        "lifetime_p25": "p25", "lifetime_p75": "p75", "lifetime_p90": "p90", "mean_lifetime_blocks": "bm", "median_lifetime_blocks": "bd", "short_lived_ratio": "short", "long_lived_ratio": "long", "rapid_consumption_ratio": "rapid",
        "same_block_ratio": "same", "lifetime_entropy": "entropy", "lifetime_repeat_ratio": "repeat_",
    }
    return f"""{CENSORED},
lt AS (SELECT wallet, ts - prev_ts AS seconds, floor((ts - prev_ts) / 86400)::BIGINT AS blocks FROM cells WHERE side = 'in' AND target AND prev_ts IS NOT NULL AND ts >= prev_ts),
{clusters('lc', 'lt', 'seconds')},
lr AS (SELECT wallet, sum(CASE WHEN size >= 2 THEN size ELSE 0 END) / sum(size) AS repeat_ FROM lc GROUP BY wallet),
la AS (SELECT wallet, count(*) AS k, avg(seconds) AS mean, quantile_cont(seconds, 0.25) AS p25, quantile_cont(seconds, 0.5) AS p50, quantile_cont(seconds, 0.75) AS p75, quantile_cont(seconds, 0.9) AS p90, stddev_pop(seconds) AS std, {cv('seconds')} AS cv,
  avg(blocks) AS bm, median(blocks) AS bd, count(*) FILTER (seconds <= 3600) / count(*) AS short, count(*) FILTER (seconds >= 86400) / count(*) AS long, count(*) FILTER (seconds <= 300) / count(*) AS rapid, count(*) FILTER (blocks = 0) / count(*) AS same,
  {duration_entropy('seconds')} AS entropy FROM lt GROUP BY wallet),
lo_ AS (SELECT wallet, count(*) AS observed FROM cells WHERE side = 'out' AND target GROUP BY wallet),
ln_ AS (SELECT wallet, count(*) AS censored FROM cens GROUP BY wallet),
lj AS (SELECT * FROM lo_ FULL JOIN la USING (wallet) LEFT JOIN ln_ USING (wallet) LEFT JOIN lr USING (wallet)),
f_lifecycle AS ({gate('lj', state('lifecycle', 'k IS NULL OR k < 3'), values)})"""


CONTINUE = """cn_ AS (SELECT wallet, tx, min(ts) AS ts, min(idx) AS idx, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o,
  len(list_intersect(coalesce(list(DISTINCT coalesce(type, '?') || '/' || lock) FILTER (side = 'in' AND target), []), coalesce(list(DISTINCT coalesce(type, '?') || '/' || lock) FILTER (side = 'out' AND target), []))) > 0 AS continues FROM cells GROUP BY wallet, tx)"""
DEPTH = """dp0 AS (SELECT wallet, tx, i > 0 AS h, sum(CASE WHEN i > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY wallet ORDER BY ts, idx, tx) AS island FROM cn_),
dp AS (SELECT wallet, max(d)::BIGINT AS depth FROM (SELECT wallet, island, sum(h::INT) AS d FROM dp0 GROUP BY ALL) GROUP BY wallet)"""


def lineage() -> str:
    values = {"merge_count": "merges", "split_count": "splits", "branch_count": "branches", "continuation_count": "continued", "continuation_ratio": "continued / n", "lineage_repetition": "repetition", "lineage_depth": "depth"}
    return f"""{CONTINUE},
{DEPTH},
la_ AS (SELECT wallet, count(*) AS n, sum(i + o)::BIGINT AS edges, count(*) FILTER (i > 1) AS merges, count(*) FILTER (o > 1) AS splits, sum(greatest(o - 1, 0))::BIGINT AS branches, count(*) FILTER (continues) AS continued FROM cn_ GROUP BY wallet),
lp_ AS (SELECT wallet, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS repetition FROM (SELECT wallet, i, o, continues, count(*) AS c FROM cn_ GROUP BY ALL) GROUP BY wallet),
lj_ AS (SELECT * FROM la_ JOIN lp_ USING (wallet) JOIN dp USING (wallet)),
f_lineage AS ({gate('lj_', state('lineage', 'edges < 3'), values)})"""


TEMPLATE = f"""tp0 AS (SELECT wallet, tx, side || ':' || CASE WHEN target THEN 'TARGET' ELSE {LOCK_FAMILY} END || ':' || {TYPE_FAMILY} || ':' || CASE WHEN asset IS NOT NULL THEN '16' ELSE '0' END AS cell,
  side || '=' || round_even(20 * capacity / nullif(sum(capacity) OVER (PARTITION BY wallet, tx, side), 0), 0)::INT AS share FROM cells),
tp1 AS (SELECT wallet, tx, array_to_string(list_sort(list(cell)), ',') AS cells_, array_to_string(list_sort(list(share)), ',') AS shares FROM tp0 GROUP BY wallet, tx),
tp AS (SELECT sh.wallet, sh.tx, sh.ts, sh.idx, sha256(concat_ws('|', topology, i, o, ti, to_, coalesce(cells_, ''), coalesce(shares, ''))) AS template FROM sh LEFT JOIN tp1 USING (wallet, tx))"""


def templates(source: str, strength: str = "NULL::DOUBLE") -> str:
    join = " LEFT JOIN f_periodicity p USING (wallet)" if strength != "NULL::DOUBLE" else ""
    pick = "p.periodicity_strength" if join else "NULL::DOUBLE"
    values = {
        "unique_template_count": "uq", "dominant_template_ratio": "top / n", "template_repeat_ratio": "repeated / n", "template_entropy": "entropy", "rare_template_ratio": "rare / n", "template_transition_entropy": "transition_entropy",
        "consecutive_template_repeat_ratio": "consecutive_repeat_ratio", "template_periodicity_support": "strength * repeated / n", "dominant_template_coverage": "top3 / n", "dominant_template_count": "k80", "transition_repeat_ratio": "transition_repeat_ratio",
    }
    return f"""tc AS (SELECT *, sum(c) OVER (PARTITION BY wallet)::BIGINT AS t, row_number() OVER (PARTITION BY wallet ORDER BY c DESC, template) AS k, sum(c) OVER (PARTITION BY wallet ORDER BY c DESC, template ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT wallet, template, count(*) AS c FROM {source} GROUP BY ALL)),
tg AS (SELECT wallet, max(t) AS n, count(*) AS uq, max(c) AS top, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS repeated, {normalized()} AS entropy, count(*) FILTER (c = 1) AS rare, sum(CASE WHEN k <= 3 THEN c ELSE 0 END) AS top3, min(CASE WHEN run / t >= 0.8 THEN k END) AS k80 FROM tc GROUP BY wallet),
{transitions('tq', source, 'template')},
tgj AS (SELECT tg.*, tq.* EXCLUDE (wallet), {pick} AS strength FROM tg LEFT JOIN tq USING (wallet){join}),
f_templates AS ({gate('tgj', state('templates', 'n < 3'), values)})"""


FAMILIES = ("temporal", "periodicity", "topology", "lifecycle", "templates", "scripts", "typed_assets", "capacity", "lineage")


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def everything(start: int) -> str:
    """All families over the order graph."""
    return with_(ORDERS, CELLS, gap_table("otx"), temporal("otx"), periodicity("otx", start), SHAPES, topology(), lifecycle(), TEMPLATE, templates("tp", "strength"), scripts(), typed_assets(), capacity(), lineage())
