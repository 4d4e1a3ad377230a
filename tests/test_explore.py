import numpy as np

from ledgerlens.operators import explore as X
from ledgerlens.operators.scheduler import finalize, next_wallets, population_hash, recover, safety_stop
from ledgerlens.streaming.live import live_sessions


def test_pca_identities():
    x = np.array([[1.0, 2.0], [2.0, 1.0], [4.0, 3.0], [3.0, 5.0]])
    share, axes, scores = X.pca(x)
    assert np.allclose(axes @ axes.T, np.eye(2)) and np.isclose(share.sum(), 1)
    assert np.allclose(scores.var(0, ddof=1) / scores.var(0, ddof=1).sum(), share)


def test_alignment():
    base = np.eye(5)
    order, cosine = X.align(base[[1, 0, 2, 3, 4]] * -1, base)
    assert order == [1, 0, 2, 3, 4] and np.allclose(cosine, 1)


def test_feasibility():
    assert X.feasible(249, 34) and X.feasible(172, 18) and not X.feasible(28, 59) and not X.feasible(46, 36)


def test_density_clusters_find_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    labels = X.density_clusters(x, 15, 5)
    assert len(set(labels[labels >= 0])) == 3 and (labels < 0).mean() < 0.2
    assert all(len(set(labels[60 * k : 60 * k + 60]) - {-1}) == 1 for k in range(3))


def test_pathology():
    assert X.pathology(np.zeros(10, int)) == "FEWER_THAN_TWO_CLUSTERS"
    assert X.pathology(np.array([-1] * 81 + [0] * 10 + [1] * 9)) == "EXCESSIVE_NOISE"
    assert X.pathology(np.array([0] * 86 + [1] * 14)) == "GIANT_CLUSTER"
    assert X.pathology(np.array([0] * 50 + [1] * 50)) is None


def test_scheduler(spark):
    schema = "address string, collection_state string, attempts int, category string"
    rows = spark.createDataFrame([("full", "NOT_STARTED", 0, "FULL_COLLECTION"), ("partial", "IN_PROGRESS", 1, "PARTIAL_REFILL"), ("local", "NOT_STARTED", 0, "ZERO_REMOTE"), ("spent", "PARTIAL", 3, "FULL_COLLECTION")], schema)
    done = finalize(recover(rows))
    state = {r["address"]: r["collection_state"] for r in done.collect()}
    assert state["partial"] == "PARTIAL" and state["spent"] == "FAILED_RETRY_EXHAUSTED"
    assert [r["address"] for r in next_wallets(done, 10).collect()] == ["local", "full"]
    assert safety_stop({"failures": 2, "requests": 10}, {"failure_rate": 0.2, "failure_sample": 5}) == "global request failure rate"


def test_population_hash_ignores_order(spark):
    a = spark.createDataFrame([("x", "1-10"), ("y", "11-50")], "address string, stratum string")
    b = spark.createDataFrame([("y", "11-50"), ("x", "1-10")], "address string, stratum string")
    c = spark.createDataFrame([("y", "11-50"), ("x", "51-200")], "address string, stratum string")
    h = [population_hash(d).first()[0] for d in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_streaming_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([10**6, 10**6, 10**6 + 100, 10**6 + 5000, 2 * 10**6])] + [(1, 0, 10**6)], "wallet long, tx long, s long").withColumn("at", F.timestamp_seconds("s"))
    rows.select("wallet", "tx", "at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("wallet long, tx long, at timestamp").parquet(str(tmp_path / "in"))
    q = live_sessions(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["started"], r["n"], r["duration"]) for r in spark.sql("select * from live").collect())
    assert got[:2] == [(10**6, 3, 100), (10**6 + 5000, 1, 0)]
