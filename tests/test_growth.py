"""What keeps the engine's queries within their limits when tables grow: rows stay in buckets, and nothing holds pairs of rows."""

import tracemalloc

import numpy as np
import pytest

from ledgerlens import catalog
from ledgerlens.functions import codec
from ledgerlens.operators import columns as K
from ledgerlens.operators import explore as X
from ledgerlens.operators import temporal as T
from ledgerlens.plans.features import feature_matrix
from ledgerlens.sources.adapters import cell_graph, order_stream

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wallets_meet_in_their_buckets(spark):
    assert "hashpartitioning" not in plan(feature_matrix(spark, TINY))
    for df in (cell_graph(spark, TINY), order_stream(spark, TINY)):
        assert "hashpartitioning" not in plan(df.groupBy("wallet").count())


def test_lags_are_no_rows(spark):
    rows = spark.createDataFrame([(w, i, int(t), i) for w in (1, 2) for i, t in enumerate(np.cumsum([5, 7, 5, 7, 5, 7, 5 + w]))], "wallet long, tx long, ts long, idx long")
    got = T.autocorrelation(rows)
    assert "Join" not in plan(got) and "Generate" not in plan(got)
    gaps = np.array([7.0, 5, 7, 5, 7, 6])
    assert {r["lag"]: r["r"] for r in got.collect() if r["wallet"] == 1} == pytest.approx({k: np.corrcoef(gaps[:-k], gaps[k:])[0, 1] for k in (1, 2, 3)})


def test_a_wallet_over_several_batches_is_one_sequence(spark):
    import pyarrow as pa

    x, w = np.random.default_rng(1).normal(size=40), np.repeat([1, 2], [30, 10])
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(w[a:b]), pa.array(x[a:b])], ["wallet", "x"])
    told = lambda parts: sorted(r for b in T._lagged(50)(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert told([batch(0, 7), batch(7, 30), batch(30, 33), batch(33, 40)]) == told([batch(0, 40)]) and len(told([batch(0, 40)])) == 20


def test_quantiles_and_modes_are_exact(spark):
    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=300), "b": np.round(rng.normal(size=300), 1), "c": np.full(300, 0.1), "d": -np.exp(rng.normal(size=300) * 30)}
    rows = [(w, *[None if w % 7 == i else float(v[w]) for i, v in enumerate(columns.values())], None) for w in range(300)]
    wide = spark.createDataFrame(rows, "wallet long, a double, b double, c double, d double, none double").repartition(5)
    q, modes = K.quantiles(wide, K.names_of(wide), (0.0, 0.01, 0.25, 0.5, 1.0)), K.modes(wide, K.names_of(wide))
    assert set(q) == set(modes) == set(columns)
    for i, (name, v) in enumerate(columns.items()):
        v = v[np.arange(300) % 7 != i]
        assert q[name][0] == len(v) and q[name][1] == pytest.approx(list(np.quantile(v, (0, 0.01, 0.25, 0.5, 1))))
        assert modes[name] == (np.unique(v, return_counts=True)[1].max(), len(np.unique(v)))


def test_pca_of_sums_is_that_of_the_matrix(spark):
    x = np.random.default_rng(3).normal(size=(80, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    wide = spark.createDataFrame([(w, *map(float, r)) for w, r in enumerate(x)] + [(99, 1.0, None, 2.0)], "wallet long, a double, b double, c double").repartition(4)
    n, mean, covariance = K.complete_covariance(wide, ["a", "b", "c"])
    assert n == 80 and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T))
    got = {(r["wallet"], r["component"]): r["score"] for r in X.scores_wide(wide, ["a", "b", "c"], mean, X.principal(covariance)[1]).collect()}
    assert len(got) == 240 and all(got[w, k + 1] == pytest.approx(X.pca(x)[2][w, k]) for w in range(80) for k in range(3))


def test_fits_have_tasks_of_their_own(spark):
    import pandas as pd

    assert X._spread(spark, 60, lambda k: pd.DataFrame({"k": [k]}), "k long").rdd.getNumPartitions() == 60


def test_density_clusters_hold_no_pairs():
    x = np.random.default_rng(5).normal(size=(6000, 2))
    tracemalloc.start()
    X.spanning_edges(x, X.core_distances(x, slice(0, 200), (5,))[:1, 0].repeat(6000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2


def test_density_grid_has_all_views(spark):
    rng = np.random.default_rng(6)
    names = [f"temporal__{k}" for k in "abcd"] + [f"topology__{k}" for k in "abcdefgh"]
    wide = spark.createDataFrame([(w, *map(float, rng.normal(5 * (w % 2), 0.3, len(names)))) for w in range(60)], "wallet long, " + ", ".join(f"{n} double" for n in names))
    runs = X.grid(wide, {"HIGH_CONFIDENCE": (names, (3, 4, 6)), "TEMPORAL_STRUCTURE": (names[:4], (3,)), "CELL_STRUCTURE": (names[4:], (7,))}).toPandas()
    assert runs["run_id"].nunique() == 192 and len(runs) == 192 * 60
    assert {len(v[1]) for v in catalog.VIEWS.values()} == {1, 3} and sum(1 + len(v[1]) for v in catalog.VIEWS.values()) == 8


def test_amounts_read_their_text_once(spark):
    rows = spark.createDataFrame([("0x" + "01" + "00" * 7 + "ff" * 8,), ("ABCDEF0000000000" + "0" * 16,), ("0x12",), (None,)], "t string")
    high, low = codec.u128(rows["t"])
    got = rows.select(high, low)
    assert plan(got).lower().count("regexp_replace") == 0
    assert [tuple(None if v is None else int(v) for v in r) for r in got.collect()] == [(2**64 - 1, 1), (0, 0xEFCDAB), (None, None), (None, None)]


def test_learning_columns_store_no_table(spark):
    known = dict(getattr(spark.sparkContext, "_ledgerlens_tables", {}))
    spark.sparkContext._ledgerlens_tables = {}
    assert catalog.QUERIES["learning_columns"](spark, TINY).count() > 100 and not spark.sparkContext._ledgerlens_tables
    spark.sparkContext._ledgerlens_tables = known
