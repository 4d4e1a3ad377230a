import pytest

from ledgerlens.config import WINDOW_START
from ledgerlens.operators import cells as C
from ledgerlens.operators import temporal as T
from ledgerlens.operators.normalize import check_window, conservation, parse_payloads, cell_rows, resolve_inputs

CELL = "wallet long, tx long, ts long, idx long, side string, pos int, capacity long, occupied long, lock long, type string, asset long, target boolean, prev_tx long, prev_pos int, prev_ts long"


def tx(spark, times, wallet=1):
    return spark.createDataFrame([(wallet, i, t, i) for i, t in enumerate(times)], "wallet long, tx long, ts long, idx long")


def test_sessions_and_bursts(spark):
    rows = tx(spark, [0, 10, 20, 4000, 4010, 4020, 8000, 8010, 8020])
    f = T.temporal_features(rows).first()
    assert (f["support_state"], f["activity_session_count"], f["burst_count"], f["transaction_count"]) == ("SUPPORTED", 3, 3, 9)
    p = T.periodicity_features(rows, 0).first()
    assert p["support_state"] == "SUPPORTED" and p["spectral_power"] is None


def test_insufficient_values_are_null(spark):
    f = T.temporal_features(tx(spark, [0, 600, 1200])).first().asDict()
    assert f.pop("support_state") == "INSUFFICIENT_EVIDENCE" and f.pop("wallet") == 1 and all(v is None for v in f.values())


def test_perfect_period(spark):
    p = T.periodicity_features(tx(spark, [600 * i for i in range(12)]), WINDOW_START).first()
    assert p["dominant_period_seconds"] == 600 and p["periodicity_strength"] == 1 and p["phase_stability"] == pytest.approx(1)


def graph(spark, shapes):
    """Transactions from (inputs, outputs) counts, all cells controlled by the wallet."""
    rows = []
    for t, (i, o) in enumerate(shapes):
        rows += [(1, t, t * 10, t, "in", k, 1000, 600, 7, None, None, True, 100 + t, k, t * 10 - 5) for k in range(i)]
        rows += [(1, t, t * 10, t, "out", k, 900, 600, 7, None, None, True, None, None, None) for k in range(o)]
    return tx(spark, [t * 10 for t in range(len(shapes))]), spark.createDataFrame(rows, CELL)


def test_one_to_many(spark):
    t, c = graph(spark, [(1, 3)] * 5)
    f = C.topology_features(t, c).first()
    assert f["one_to_many_ratio"] == 1 and f["fragmentation_event_count"] == 5 and f["dominant_topology"] == "1_TO_N"


def test_lineage_and_capacity(spark):
    t, c = graph(spark, [(2, 3)] * 3)
    f = C.lineage_features(c).first()
    assert (f["merge_count"], f["split_count"], f["support_state"]) == (3, 3, "SUPPORTED")
    t, c = graph(spark, [(1, 1)] * 3)
    assert C.capacity_features(c).first()["target_net_capacity_delta"] == -300


def test_template_ignores_lock_and_time(spark):
    t, c = graph(spark, [(1, 3)] * 5)
    assert C.template_of_cells(t, c).select("template").distinct().count() == 1


def test_lineage_depth_follows_spends(spark):
    rows = [(1, 0, 0, 0, "out", 0, 9, 1, 7, None, None, True, None, None, None)]
    for t in range(1, 4):
        rows += [(1, t, t, t, "in", 0, 9, 1, 7, None, None, True, t - 1, 0, t - 1), (1, t, t, t, "out", 0, 9, 1, 7, None, None, True, None, None, None)]
    assert C.lineage_depth(spark.createDataFrame(rows, CELL)).first()["depth"] == 3


def test_window_has_thirty_days():
    check_window(0, 30 * 86400)
    with pytest.raises(ValueError):
        check_window(1, 2)


PAYLOAD = '{"transaction_hash": "0xa", "block_timestamp": "1700000000000", "transaction_fee": "%s", "display_inputs": [{"capacity": "100", "lock_hash": "l", "previous_output": {"tx_hash": "0xp", "index": 1}}], "display_outputs": [{"capacity": "90", "lock_hash": "l"}]}'


def test_wrapped_and_root_payloads_agree(spark):
    raw = PAYLOAD % 10
    rows = parse_payloads(spark.createDataFrame([(raw,), ('{"data": {"id": "1", "attributes": %s}}' % raw,), ("not json",)], "payload string")).collect()
    assert rows[0][1:] == rows[1][1:] and rows[0]["block_timestamp"] == 1700000000 and rows[2]["tx_hash"] is None


@pytest.mark.parametrize(("fee", "status"), [(10, "complete"), (9, "failed")])
def test_conservation(spark, fee, status):
    parsed = parse_payloads(spark.createDataFrame([(PAYLOAD % fee,)], "payload string"))
    cells = cell_rows(parsed).withColumnRenamed("tx_hash", "tx")
    assert conservation(parsed.withColumnRenamed("tx_hash", "tx"), cells).first()["status"] == status


def test_resolution_order(spark):
    inputs = spark.createDataFrame([("t", "a", 0), ("t", "b", 0), ("t", "c", 7)], "tx string, prev_tx string, prev_pos int")
    first = spark.createDataFrame([("a", 0, 5, "x")], "tx string, pos int, capacity long, lock string")
    second = spark.createDataFrame([("a", 0, 6, "x"), ("b", 0, 7, "y")], "tx string, pos int, capacity long, lock string")
    got = {r["prev_tx"]: (r["resolved_capacity"], r["resolution_source"], r["resolution_status"]) for r in resolve_inputs(inputs, [("local", first), ("cache", second)]).collect()}
    assert got == {"a": (5, "local", "complete"), "b": (7, "cache", "complete"), "c": (None, None, "missing")}
