"""Registered queries of evidence, review sets, diagnostics and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import catalog as K
from ledgerlens.catalog import query, tidied
from ledgerlens.catalog_first import first_matrix
from ledgerlens.functions import codec
from ledgerlens.operators import cells as C
from ledgerlens.operators import explore as X
from ledgerlens.operators import first as V
from ledgerlens.operators import review as W
from ledgerlens.operators import rules as R
from ledgerlens.operators import scheduler as P
from ledgerlens.operators import temporal as T
from ledgerlens.plans import first_sql as Q1
from ledgerlens.plans import sql as Q
from ledgerlens.plans.features import feature_matrix
from ledgerlens.sources.adapters import cell_graph, event_stream, load, order_stream

_GAPS = Q.with_(Q.EVENTS, Q.gap_table("ev"))
_GRAPH = Q.with_(Q.ORDERS, Q.CELLS)
_RULES = K._ALL + K._RULE_CTE
_KNOWN = "kn AS (SELECT rule, wallet, threshold_met, round(score, 6) AS score FROM {source} WHERE support_state IN ('SUPPORTED', 'PARTIAL') AND score IS NOT NULL)"


@query("nearest_rank_gaps", tidied(_GAPS.rstrip() + ",\nnr AS (SELECT wallet, gap, row_number() OVER (PARTITION BY wallet ORDER BY gap) - 1 AS at_, count(*) OVER (PARTITION BY wallet) AS n FROM g1 WHERE gap IS NOT NULL)\n",
       "(SELECT wallet, " + ", ".join(f"max(gap) FILTER (at_ = round_even((n - 1) * {p}::DOUBLE, 0)) AS p{round(100 * p):02d}" for p in (0.1, 0.5, 0.9)) + " FROM nr GROUP BY wallet)", ["wallet", "p10", "p50", "p90"]))
def nearest_rank_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.nearest_rank(T.gaps(event_stream(spark, d)), "wallet", "gap", (0.1, 0.5, 0.9))


@query("first_and_last_seen", tidied(Q.with_(Q.EVENTS), "(SELECT wallet, min(ts) AS started, max(ts) AS seconds, count(*) AS n FROM ev GROUP BY wallet)", ["wallet", "started", "seconds", "n"]))
def first_and_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return W.first_and_last(event_stream(spark, d)).select("wallet", F.col("first_seen").alias("started"), F.col("last_seen").alias("seconds"), F.col("tx_count").alias("n"))


@query("activity_diagnostics", tidied(_GRAPH.rstrip() + """,
ad AS (SELECT tx, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, count(*) FILTER (target) AS t FROM cells GROUP BY tx),
ae AS (SELECT c_custkey AS wallet, count(x.tx) AS transaction_count, coalesce(sum(i), 0) AS input_count, coalesce(sum(o), 0) AS output_count, coalesce(sum(t), 0) AS observed_cell_count FROM customer LEFT JOIN otx x ON x.wallet = c_custkey LEFT JOIN ad ON ad.tx = x.tx GROUP BY 1)
""", "ae", ["wallet", "transaction_count", "input_count", "output_count", "observed_cell_count"]))  # fmt: skip
def activity_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return W.activity(load(spark, d, "customer").select(F.col("c_custkey").alias("wallet")), order_stream(spark, d), cell_graph(spark, d))


@query("input_status_counts", f"""{_GRAPH.rstrip()},
st AS (SELECT o.o_orderstatus AS kind, CASE WHEN m.tx IS NOT NULL THEN 'complete' ELSE 'missing' END AS status FROM cells c JOIN orders o ON o.o_orderkey = c.tx
  LEFT JOIN (SELECT tx, pos FROM cells WHERE side = 'out' AND tx % 3 = 0) m ON m.tx = c.prev_tx AND m.pos = c.prev_pos WHERE c.side = 'in')
SELECT kind, status, count(*)::BIGINT AS n FROM st GROUP BY ALL""")
def input_status_counts(spark: SparkSession, d: str) -> DataFrame:
    cells = cell_graph(spark, d)
    made = cells.filter("side = 'out' and tx % 3 = 0").select("tx", "pos", "capacity", "lock")
    resolved = K.N.resolve_inputs(cells.filter("side = 'in'").select("tx", "prev_tx", "prev_pos"), [("local", made)])
    kinds = load(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_orderstatus").alias("kind"))
    return resolved.join(kinds, "tx").groupBy("kind", F.col("resolution_status").alias("status")).agg(F.count("*").alias("n"))


_SUPPORTING = "ev_ AS (SELECT wallet, tx, 'CELL_FRAGMENTATION' AS rule FROM sh WHERE ti > 0 AND to_ > ti UNION ALL SELECT wallet, tx, 'CELL_CONSOLIDATION' FROM sh WHERE to_ > 0 AND ti > to_)"


@query("rule_evidence", f"""{Q.with_(Q.ORDERS, Q.CELLS, Q.SHAPES).rstrip()},
{_SUPPORTING}, er AS (SELECT *, row_number() OVER (PARTITION BY wallet, rule ORDER BY tx) AS place FROM ev_)
SELECT wallet::BIGINT AS wallet, rule, string_agg(lpad(tx::VARCHAR, 20, '0'), ',' ORDER BY tx) FILTER (place <= 100) AS tx_hashes, count(*)::BIGINT AS tx_count FROM er GROUP BY wallet, rule""")
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = C.shapes(order_stream(spark, d), cell_graph(spark, d))
    split, joined = s.filter("ti > 0 and to > ti"), s.filter("to > 0 and ti > to")
    named = lambda df, rule: df.select("wallet", F.lit(rule).alias("rule"), "tx")
    return W.evidence(named(split, "CELL_FRAGMENTATION").union(named(joined, "CELL_CONSOLIDATION")))


@query("lineage_edges", tidied(_GRAPH, "(SELECT wallet, tx, side, pos, row_number() OVER (PARTITION BY wallet ORDER BY ts, tx, side, pos) AS place FROM cells WHERE side = 'out' OR prev_tx IS NOT NULL QUALIFY place <= 1000)", ["wallet", "tx", "pos", "place"], ("side",)))
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.lineage_edges(cell_graph(spark, d))


@query("review_sets", tidied(_RULES.rstrip() + f""",
{_KNOWN.format(source="rr")},
r1 AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC, wallet) AS place FROM kn WHERE threshold_met QUALIFY place <= 5),
r2 AS (SELECT kn.* FROM kn ANTI JOIN r1 USING (rule, wallet)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY threshold_met DESC, CASE WHEN threshold_met THEN score ELSE -score END, wallet) AS place FROM r2 QUALIFY place <= 5),
r4 AS (SELECT r2.*, row_number() OVER (PARTITION BY rule ORDER BY score, wallet) AS place FROM r2 ANTI JOIN r3 USING (rule, wallet) WHERE NOT threshold_met QUALIFY place <= 5),
rs AS (SELECT rule, 'STRONG' AS category, wallet, score, place FROM r1 UNION ALL SELECT rule, 'BORDERLINE', wallet, score, place FROM r3 UNION ALL SELECT rule, 'NEGATIVE', wallet, score, place FROM r4)
""", "rs", ["wallet", "score", "place"], ("rule", "category")))  # fmt: skip
def review_sets(spark: SparkSession, d: str) -> DataFrame:
    return W.review_sets(R.evaluate(feature_matrix(spark, d)))


@query("first_examples", tidied(Q1.BASE.rstrip() + ",\n" + Q1.MATRIX + ",\n" + Q1.RULES + """,
fe AS (SELECT rule, wallet, round(score, 6) AS score FROM ar WHERE score IS NOT NULL),
fx AS (SELECT rule, 'STRONG' AS category, wallet, score, row_number() OVER (PARTITION BY rule ORDER BY score DESC, wallet) AS place FROM fe QUALIFY place <= 10
  UNION ALL SELECT rule, 'BORDERLINE', wallet, score, row_number() OVER (PARTITION BY rule ORDER BY round(abs(score - 2 / 3), 6), wallet) AS place FROM fe QUALIFY place <= 5)
""", "fx", ["wallet", "score", "place"], ("rule", "category")))  # fmt: skip
def first_examples(spark: SparkSession, d: str) -> DataFrame:
    return W.examples(V.evaluate(first_matrix(spark, d)))


_STRATA = "CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' ELSE '51-200' END"


@query("stratified_pick", tidied(Q.with_(Q.EVENTS), f"""(SELECT wallet, stratum, score, row_number() OVER (ORDER BY best DESC, score DESC, wallet DESC) AS place FROM
(SELECT wallet, n AS score, {_STRATA} AS stratum, (row_number() OVER (PARTITION BY {_STRATA} ORDER BY n DESC, wallet DESC) = 1)::INT AS best FROM (SELECT wallet, count(*) AS n FROM ev GROUP BY wallet)) QUALIFY place <= 8)""", ["wallet", "score", "place"], ("stratum",)))
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    n = event_stream(spark, d).groupBy("wallet").agg(F.count("*").alias("score"))
    return W.stratified_pick(n.withColumn("stratum", codec.sampling_stratum(F.col("score"))))


@query("rule_enrichment", tidied(_RULES.rstrip() + """,
re0 AS (SELECT rule, wallet % 4 AS k, (support_state IN ('SUPPORTED', 'PARTIAL'))::INT AS s, (support_state IN ('SUPPORTED', 'PARTIAL') AND threshold_met)::INT AS p FROM rr),
re1 AS (SELECT rule, sum(p) / nullif(sum(s), 0) AS base FROM re0 GROUP BY rule),
re2 AS (SELECT k, rule, sum(s) AS supported_count, sum(p) AS positive_count, sum(p) / nullif(sum(s), 0) AS positive_ratio, any_value(base) AS cohort_positive_ratio, sum(p) / nullif(sum(s), 0) / nullif(any_value(base), 0) AS enrichment_ratio FROM re0 JOIN re1 USING (rule) GROUP BY k, rule)
""", "re2", ["k", "supported_count", "positive_count", "positive_ratio", "cohort_positive_ratio", "enrichment_ratio"], ("rule",)))  # fmt: skip
def rule_enrichment(spark: SparkSession, d: str) -> DataFrame:
    m = feature_matrix(spark, d)
    return W.enrichment(R.evaluate(m), m.select("wallet", (F.col("wallet") % 4).alias("label"))).withColumnRenamed("label", "k")


@query("adjusted_mutual_information")
def adjusted_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    table = [(r["left"], r["right"], r["n"]) for r in K._two_labels(spark, d).collect()]
    return spark.createDataFrame([(W.adjusted_mutual_information(table),)], "ami double")


_FAILED = "sf AS (SELECT c_custkey::VARCHAR AS address, (['FAILED', 'PARTIAL', 'COMPLETE', 'FAILED_RETRY_EXHAUSTED'])[c_custkey % 4 + 1] AS collection_state, CASE WHEN c_custkey % 8 = 0 THEN 'Invalid frozen wallet address: x' WHEN c_custkey % 3 = 0 THEN 'timed out' END AS last_error, (['EXPLORER_TIMEOUT', 'CACHE_CORRUPTION', NULL, 'STRANGE', 'RETRY_EXHAUSTED'])[c_custkey % 5 + 1] AS last_error_type, NULL::VARCHAR AS failure_scope FROM customer)"
_MIGRATED = _FAILED + """,
sm AS (SELECT address, last_error, CASE WHEN collection_state <> 'FAILED' THEN collection_state WHEN lower(coalesce(last_error, '')) LIKE '%invalid frozen wallet address%' THEN 'FAILED_INVALID_ADDRESS' ELSE 'FAILED_RETRY_EXHAUSTED' END AS collection_state,
  CASE WHEN collection_state <> 'FAILED' THEN last_error_type ELSE coalesce(last_error_type, CASE WHEN lower(coalesce(last_error, '')) LIKE '%invalid frozen wallet address%' THEN 'INVALID_ADDRESS' ELSE 'RETRY_EXHAUSTED' END) END AS last_error_type,
  CASE WHEN collection_state <> 'FAILED' THEN failure_scope ELSE coalesce(failure_scope, 'WALLET') END AS failure_scope FROM sf)"""


def _failed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
    return load(spark, d, "customer").select(
        k.cast("string").alias("address"), pick(["FAILED", "PARTIAL", "COMPLETE", "FAILED_RETRY_EXHAUSTED"]).alias("collection_state"), F.when(k % 8 == 0, "Invalid frozen wallet address: x").when(k % 3 == 0, "timed out").alias("last_error"),
        pick(["EXPLORER_TIMEOUT", "CACHE_CORRUPTION", None, "STRANGE", "RETRY_EXHAUSTED"]).alias("last_error_type"), F.lit(None).cast("string").alias("failure_scope"),
    )


@query("migrated_failures", f"WITH {_MIGRATED}\nSELECT * FROM sm")
def migrated_failures(spark: SparkSession, d: str) -> DataFrame:
    return P.migrate_failures(_failed(spark, d))


@query("retry_candidates", f"""WITH {_MIGRATED}
SELECT address, collection_state, CASE WHEN last_error_type IN {P.SERVICE_ERRORS} THEN 'Explorer timeout/service' WHEN last_error_type IN {P.CODE_ERRORS} THEN 'schema/data issue' ELSE 'other' END AS failure_category,
  CASE WHEN last_error_type IN {P.SERVICE_ERRORS} THEN 'RETRY_LATER' WHEN last_error_type IN {P.CODE_ERRORS} THEN 'NEEDS_CODE_FIX' ELSE 'NEEDS_MANUAL_REVIEW' END AS recommendation FROM sm WHERE collection_state IN ('PARTIAL', 'FAILED_RETRY_EXHAUSTED')""")
def retry_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.retry_candidates(P.migrate_failures(_failed(spark, d)))


@query("hex_capacities", "SELECT l_orderkey::BIGINT AS tx, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS capacity FROM lineitem GROUP BY l_orderkey")
def hex_capacities(spark: SparkSession, d: str) -> DataFrame:
    told = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), F.concat(F.lit("0x"), F.lower(F.hex(F.round(F.col("l_extendedprice") * 100).cast("bigint")))).alias("told"))
    return told.groupBy("tx").agg(F.sum(codec.hex_int(F.col("told"))).alias("capacity"))


@query("seed_addresses", "SELECT address, max(event_id)::BIGINT AS number FROM (SELECT event_id, unnest([user_id::VARCHAR, event_type]) AS address FROM events) GROUP BY address ORDER BY number DESC, address LIMIT 50")
def seed_addresses(spark: SparkSession, d: str) -> DataFrame:
    blocks = load(spark, d, "events").select(F.col("event_id").alias("number"), F.array(F.col("user_id").cast("string"), "event_type").alias("addresses"))
    return W.seed_addresses(blocks, 50).withColumnRenamed("block", "number")


@query("seen_payloads", tidied(Q.with_(Q.EVENTS), f"(SELECT wallet, tx, length(props) AS n FROM ev WHERE ts >= {K.WINDOW_START + 86400} AND ts < {K.WINDOW_START + 8 * 86400})", ["wallet", "tx", "n"]))
def seen_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    met = K.N.seen_payloads(e.select("wallet", "tx", "ts"), e.select("tx", "props"), K.WINDOW_START + 86400, K.WINDOW_START + 8 * 86400)
    return met.select("wallet", "tx", F.length("props").alias("n"))


def _components(spark: SparkSession, d: str) -> tuple[list, DataFrame]:
    scaled = K._scaled(spark, d, K.EXPLORED)
    names = sorted(X.K.names_of(scaled))
    _, mean, covariance = X.K.complete_covariance(scaled, names)
    axes = X.principal(covariance)[1]
    return X.loadings(names, axes), X.scores_wide(scaled, names, mean, axes)


@query("pca_loadings")
def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_components(spark, d)[0], "k long, feature string, loading double, family string, share double, dominant boolean")


@query("pca_tails")
def pca_tails(spark: SparkSession, d: str) -> DataFrame:
    return X.tails(_components(spark, d)[1]).withColumnRenamed("component", "k")


@query("pca_activity")
def pca_activity(spark: SparkSession, d: str) -> DataFrame:
    tx = order_stream(spark, d).groupBy("wallet").agg(F.count("*").cast("double").alias("level")).select("wallet", F.lit("transactions").alias("metric"), "level")
    return X.activity_of_components(_components(spark, d)[1], tx).withColumnRenamed("component", "k")
