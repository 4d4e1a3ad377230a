"""The redundancy audit pairs every feature of all nine families."""

import itertools

import numpy as np
import pytest

from ledgerlens import catalog
from ledgerlens.operators import audit as A
from ledgerlens.operators import temporal as T
from ledgerlens.plans.features import FAMILIES

TINY = "/root/testdata/sf0.001"


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_every_pair_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=60)
    columns = {"temporal__a": base, "scripts__b": base * 2 + 1, "templates__c": np.round(rng.normal(size=60), 1), "periodicity__d": rng.normal(size=60), "typed_assets__e": -base}
    columns["periodicity__d"][:5] = np.nan
    rows = [(w, f, None if np.isnan(v[w]) else float(v[w])) for f, v in columns.items() for w in range(60)]
    matrix = spark.createDataFrame(rows, "wallet long, feature string, value double")
    got = {(r["l"], r["r"]): r for r in A.pair_correlations(matrix).collect()}
    assert set(got) == set(itertools.combinations(sorted(columns), 2))
    for (l, r), row in got.items():
        both = ~np.isnan(columns[l]) & ~np.isnan(columns[r])
        x, y = columns[l][both], columns[r][both]
        assert row["n"] == both.sum() and row["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and row["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    groups = {r["feature"]: r["root"] for r in A.redundancy_groups(A.redundancy(A.pair_correlations(matrix))).collect()}
    assert groups == dict.fromkeys(("temporal__a", "scripts__b", "typed_assets__e"), "scripts__b")


def test_audited_matrix_has_nine_families(spark):
    names = {r["feature"] for r in catalog._matrix(spark, TINY).select("feature").distinct().collect()}
    assert {n.split("__")[0] for n in names} == set(FAMILIES)
    learning = {r["feature"] for r in catalog.QUERIES["learning_columns"](spark, TINY).collect()}
    assert learning < names and {n.split("__")[0] for n in learning} == set(FAMILIES)


def test_wallet_without_positive_gaps_has_no_period(spark):
    rows = spark.createDataFrame([(1, i, 100, i) for i in range(9)], "wallet long, tx long, ts long, idx long")
    f = T.periodicity_features(rows, 0).first()
    assert f["support_state"] != "SUPPORTED" and f["interval_cluster_concentration"] is None
