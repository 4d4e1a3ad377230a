"""The dedup stage joins documents from a likeness of 0.80."""

import corpus_pipeline as P
from ledgerlens.llm import near_dedup as N


def test_bands_keep_the_miss_rate():
    assert [(N.bands_for(s), N.bins_for(N.bands_for(s))) for s in (85, 80)] == [(24, 128), (35, 256)]
    for s in (70, 80, 85, 90):
        assert (1 - (s / 100) ** N.ROWS) ** N.bands_for(s) < N.MISS


def test_stage_joins_at_eighty(spark, tmp_path):
    w = [f"w{i}" for i in range(104)]  # 100 shingles
    text = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    # One edit inside changes 5 shingles: 90 / 110 = 0.818 with two, 85 / 115 = 0.739 with three.
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate((text(), text(30, 60), text(20, 50, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.dedup(spark, docs, str(tmp_path)).collect()) == [0, 2]
    assert N.near_dedup(docs).filter("kept").count() == 3
