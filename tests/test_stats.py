import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import codec
from ledgerlens.functions import stats as S


def one(spark, values, expression):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(expression(F.col("x")).alias("v")).first()["v"]


def test_quantile_interpolates(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0], lambda x: S.quantile(x, 0.5)) == 2.5


def test_small_samples_are_null(spark):
    assert one(spark, [1.0], S.cv) is None
    assert one(spark, [1.0, 2.0], S.skewness) is None
    assert one(spark, [1.0, 2.0, 3.0], S.kurtosis) is None
    assert one(spark, [2.0, 2.0, 2.0, 2.0], S.kurtosis) == 0.0


def test_tolerant_clusters_repeat_ratio(spark):
    row = spark.createDataFrame([([100.0, 101.0, 500.0],)], "g array<double>").select(S.tolerant_clusters(F.col("g")).alias("c")).first()
    assert row["c"] == [[100.0, 101.0], [500.0]]
    v = spark.createDataFrame([([100.0, 101.0, 500.0],)], "g array<double>").select(S.repeat_ratio_of_clusters(S.tolerant_clusters(F.col("g"))).alias("v")).first()["v"]
    assert v == pytest.approx(2 / 3)


def test_pearson_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.pearson(F.col("x"), F.col("y")).alias("r")).first()["r"] is None


def test_amounts(spark):
    good = "0x" + (123456).to_bytes(16, "little").hex()
    rows = spark.createDataFrame([(good, True), ("0x" + "zz" * 16, True), ("0x00", True), (good, False)], "h string, k boolean")
    high, low = codec.u128(F.col("h"))
    got = rows.select(high.alias("a"), low.alias("b"), codec.decode_status(F.col("k"), F.col("h")).alias("s")).collect()
    assert [r["s"] for r in got] == ["DECODED", "INVALID_AMOUNT_ENCODING", "MISSING_16_BYTE_AMOUNT", "METADATA_MISMATCH"]
    assert (int(got[0]["a"]), int(got[0]["b"])) == (0, 123456) and got[1]["b"] is None


def test_strata(spark):
    cases = [(None, "unknown"), (0, "unknown"), (1, "1-10"), (10, "1-10"), (11, "11-50"), (50, "11-50"), (51, "51-200"), (200, "51-200"), (201, "201-500"), (500, "201-500"), (501, "501-1000"), (1000, "501-1000"), (1001, "1001-5000"), (5000, "1001-5000"), (5001, "5000+")]
    rows = spark.createDataFrame(cases, "n long, s string").select(codec.sampling_stratum(F.col("n")).alias("got"), "s").collect()
    assert all(r["got"] == r["s"] for r in rows)


def test_bech32_accepts_its_own_checksums_only(spark):
    def polymod(values):
        c = 1
        for v in values:
            top = c >> 25
            c = (c & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate(codec.BECH32_GENERATOR):
                c ^= g if (top >> i) & 1 else 0
        return c

    data = [3, 14, 20, 7, 7, 19]
    head = [ord(c) >> 5 for c in "ckb"] + [0] + [ord(c) & 31 for c in "ckb"]
    made = []
    for target in codec.BECH32_SUMS:
        p = polymod(head + data + [0] * 6) ^ target
        made.append("ckb1" + "".join(codec.BECH32[d] for d in data + [(p >> 5 * (5 - i)) & 31 for i in range(6)]))
    bad = made[0][:-1] + ("q" if made[0][-1] != "q" else "p")
    rows = spark.createDataFrame([(x,) for x in [*made, bad, "ckb1", None]], "a string").select(codec.valid_address(F.col("a")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, True, False, False, False]


def test_script_hash_is_null_on_malformed(spark):
    rows = spark.createDataFrame([("0x" + "11" * 32, "type", "0xaaaa"), ("0x11", "type", "0x"), ("0x" + "11" * 32, "nope", "0x")], "c string, t string, a string")
    got = [r[0] for r in rows.select(codec.script_hash(F.col("c"), F.col("t"), F.col("a"))).collect()]
    assert len(got[0]) == 66 and got[1] is None and got[2] is None
