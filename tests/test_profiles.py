"""Every wallet has its profile document; a page has fifty."""

import json

from ledgerlens import catalog
from ledgerlens.plans import profile as D
from ledgerlens.plans.features import feature_matrix

SF = "/root/testdata/sf0.001"


def test_all_profiles_are_returned(spark, monkeypatch):
    rows = spark.range(120).selectExpr("id as wallet", "'{}' as profile")
    monkeypatch.setattr(catalog, "feature_matrix", lambda *_: rows)
    monkeypatch.setattr(catalog.D, "documents", lambda features: features)
    count = lambda name: catalog.QUERIES[name](spark, "").select("wallet").distinct().count()
    assert count("profile_document") == 120 and count("profile_page") == 50


def rounded(text):
    """The document with floats to nine places: sums may be taken in another order."""
    return json.loads(text, parse_float=lambda x: round(float(x), 9))


def test_the_profile_of_one_wallet_is_its_row_of_all(spark):
    every = {r["wallet"]: r["profile"] for r in D.documents(feature_matrix(spark, SF)).collect()}
    wallet = min(every)
    assert [rounded(r["profile"]) for r in D.profile(spark, SF, wallet).collect()] == [rounded(every[wallet])]
