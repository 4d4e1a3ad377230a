"""Agreement, picks, evidence and contracts on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import codec
from ledgerlens.operators import explore as X
from ledgerlens.operators import first as V
from ledgerlens.operators import review as W
from ledgerlens.operators import scheduler as P
from ledgerlens.operators import temporal as T


def table(a, b):
    return [(x, y, n) for (x, y), n in Counter(zip(a, b)).items()]


def test_adjusted_mutual_information_against_shuffles():
    rng = random.Random(2)
    a, b = [k % 3 for k in range(24)], [k // 8 if k % 5 else 0 for k in range(24)]

    def mutual(x, y):
        left, right, both = Counter(x), Counter(y), Counter(zip(x, y))
        return sum(n / 24 * math.log(n * 24 / (left[i] * right[j])) for (i, j), n in both.items())

    entropy = lambda x: -sum(n / 24 * math.log(n / 24) for n in Counter(x).values())
    expected = sum(mutual(a, rng.sample(b, 24)) for _ in range(20000)) / 20000
    want = (mutual(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)
    assert W.adjusted_mutual_information(table(a, b)) == pytest.approx(want, abs=0.01)
    assert W.adjusted_mutual_information(table(a, a)) == pytest.approx(1) and W.adjusted_mutual_information([]) == 1


def test_hex_and_contract(spark):
    rows = spark.createDataFrame([("0x1f", ), ("0xffffffffffffffff",), ("1f",), ("0x",), ("0xzz",), (None,)], "t string")
    assert [r[0] for r in rows.select(codec.hex_int(F.col("t")).cast("string")).collect()] == ["31", "18446744073709551615", None, None, None, None]
    frozen = P.freeze({"a": 1}, None)
    assert P.freeze({"a": 1}, frozen) is frozen
    with pytest.raises(ValueError):
        P.freeze({"a": 2}, frozen)


def test_nearest_rank_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("w", x) for x in (40, 10, 30, 20)] + [("w", None), ("v", 7)], "wallet string, gap int")
    got = {r["wallet"]: (r["p50"], r["p90"]) for r in W.nearest_rank(rows, "wallet", "gap", (0.5, 0.9)).collect()}
    assert got == {"w": (30, 40), "v": (7, 7)}


def test_evidence_is_cut_but_counted(spark):
    rows = spark.createDataFrame([(1, "R", k % 150) for k in range(300)], "wallet long, rule string, tx long")
    r = W.evidence(rows).first()
    assert r["tx_count"] == 150 and len(r["tx_hashes"].split(",")) == 100


def test_first_families_of_thin_wallets_are_null(spark):
    tx = spark.createDataFrame([(1, 1, 100, 1), (2, 5, 10, 5), (2, 6, 10, 6)], "wallet long, tx long, ts long, idx long")
    for r in V.temporal(tx).collect():
        assert r["support_state"] == "INSUFFICIENT_EVIDENCE" and all(r[c] is None for c in r.asDict() if c not in ("wallet", "support_state"))
    assert T.periodicity_features(tx, 0).count() == 2


def test_cutoffs_one_by_one(spark):
    row = (1, "SUPPORTED", 0.85, 0.9, 0.3, "SUPPORTED", 0.0, 0.0, 0.0, 0.0, 0.0, "SUPPORTED", 0.0)
    names = "wallet long, temporal__support_state string, temporal__periodicity_strength double, temporal__phase_stability double, temporal__interarrival_cv double, topology__support_state string, topology__fanout_transaction_ratio double, topology__mean_external_output_locks double, topology__fanin_transaction_ratio double, topology__mean_external_input_locks double, topology__topology_repeat_ratio double, templates__support_state string, templates__template_repeat_ratio double"
    m = spark.createDataFrame([row], names)
    got = {r["metric"]: (r["at_low"], r["at_base"], r["at_high"], r["verdict"]) for r in V.sensitivity(m).filter("rule = 'PERIODIC_EXECUTION'").collect()}
    assert got["periodicity_strength"] == (True, True, False, "threshold-sensitive") and got["phase_stability"] == (True, True, True, "stable")
    assert got["interarrival_cv"] == (False, True, True, "threshold-sensitive") and got["ALL"] == (False, True, False, "threshold-sensitive")
    rule = {r["rule"]: r for r in V.evaluate(m).collect()}
    assert rule["PERIODIC_EXECUTION"]["supported"] and rule["PERIODIC_EXECUTION"]["score"] == 1 and rule["BATCH_DISTRIBUTION"]["score"] == 0


def test_scripts_are_named_by_code_hash_and_type(spark):
    code = next(c for (c, k), f in codec.SCRIPTS.items() if f == "XUDT")
    rows = spark.createDataFrame([(code, "data1", "0x1", False), (code, "type", "0x2", False), (None, "type", None, False), (code, "data1", "0x3", True)], "code string, kind string, digest string, own boolean")
    got = [r[0] for r in rows.select(codec.family_or_digest(F.col("code"), F.col("kind"), F.col("digest"), F.col("own"))).collect()]
    assert got == ["XUDT", "0x2", "UNKNOWN", "TARGET"]


def test_scores_and_loadings_agree_with_the_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    names = ["a__x", "a__y", "b__z"]
    scaled = spark.createDataFrame([(w, n, float(x[w, i])) for w in range(40) for i, n in enumerate(names)] + [(99, "a__x", 1.0)], "wallet long, feature string, scaled double")
    _, axes, scores = X.pca(x)
    long = X.scores_long(scaled, names, x, axes)
    got = {(r["wallet"], r["component"]): r["score"] for r in long.collect()}
    assert len(got) == 120 and all(got[w, k + 1] == pytest.approx(scores[w, k]) for w in range(40) for k in range(3))
    rows = X.loadings(names, axes)
    for k in (1, 2, 3):
        assert sum(v * v for c, _, v, *_ in rows if c == k) == pytest.approx(1) and sum({f: s for c, _, _, f, s, _ in rows if c == k}.values()) == pytest.approx(1)
    low = [r["wallet"] for r in X.tails(long).filter("component = 1 and tail = 'LOW'").orderBy("place").collect()]
    assert low == list(np.argsort(scores[:, 0])[:5])


def test_labels_of_a_wallet_never_reach_its_features(spark):
    rows = [(w, 10 * w + k, 100 * k * k + w, 10 * w + k) for w in range(3) for k in range(9)]
    tx = spark.createDataFrame(rows, "wallet long, tx long, ts long, idx long")
    marked = tx.withColumn("label", F.lit("EXCHANGE")).withColumn("stratum", F.rand(3)).withColumn("collection_state", F.col("wallet").cast("string"))
    for family in (T.temporal_features, V.temporal, lambda d: T.periodicity_features(d, 0)):
        assert family(tx).exceptAll(family(marked)).isEmpty() and family(tx).columns == family(marked).columns
