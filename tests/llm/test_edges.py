"""Every operator on nulls in any column, null ids, repeated rows, empty and very long texts, and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import brown_lm, fingerprint, mixing, near_dedup, packing, quality_model, quality_rules, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "kept h n key node row label word class at part bits copies links anchors bucket chunk room size target rate name aims score score_ held_out known base own tails places stays comp pair members _row _rows _source _hash".split()


def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    made = [(k, " ".join(word() for _ in range(rng.randint(1, 60))), "en", "s", 1) for k in range(30)]
    made += [(None, "text without an id", "en", None, None), (None, "another text without an id", None, None, None), (None, None, None, None, None), (50, None, None, None, None), (51, "", "", "", 0)]
    return [*made, (52, "long " * 30000 + "end", "en", "s", 1), (53, made[0][1], "en", "s", 1), (3, made[3][1], "en", "s", 1), (3, made[3][1], "en", "s", 1), (3, "same id, other text", "en", "s", 1)]


def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(30)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
    "packing": lambda s, d: packing.pack(d, budget=64, buckets=3),
    "quality_model": lambda s, d: quality_model.score_quality(d, labels(s)),
    "near_dedup": lambda s, d: near_dedup.near_dedup(d),
    "mixing": lambda s, d: mixing.plan(d),
    "fingerprint": lambda s, d: fingerprint.fingerprints(d),
    "brown_lm": lambda s, d: brown_lm.score_texts(d, seeds=10, head=20),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3).cache()
    clash = docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    key = lambda r: tuple(str(x) for x in r)
    plain, odd = (sorted(map(key, OPERATORS[name](spark, d).collect())) for d in (docs, clash))
    assert len(plain) == len(rows()) and plain == odd


def test_rows_that_pass_through_keep_their_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHES])
    assert mixing.emit(docs).columns == docs.columns
    kept = near_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 3
    # Row 53 copies row 0; row 3 repeats once as it is, and its other text belongs to the same document.
    assert sorted(r["doc_id"] for r in kept.filter("doc_id in (0, 3, 53)").select("doc_id").collect()) == [0, 3, 3]
    assert toxicity.drop_toxic(docs, labels(spark)).columns == docs.columns
    store = sharding.compacted(docs, str(tmp_path / "s"), 5, 1 << 20)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect())) and len(store.versions()) <= 2


def test_null_ids_of_a_source_meet_its_target(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    for r in mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert 0.9 < r["taken"] / r["target"] < 1.1


def test_oversize_rows_stand_alone_and_no_batch_is_over_the_budget(spark):
    docs = spark.createDataFrame([(k, "w " * n) for k, n in enumerate([1, 5, 60, 63, 64, 65, 90, 400, 400, 64])], "doc_id long, text string")
    rows_ = packing.pack(docs, budget=64, buckets=3).collect()
    for batch in {r["batch_id"] for r in rows_}:
        own = [r for r in rows_ if r["batch_id"] == batch]
        if own[0]["oversize"]:
            assert len(own) == 1 and own[0]["padded_len"] == own[0]["n_tokens"] > 64
        else:
            assert sum(r["padded_len"] for r in own) <= 64 and all(r["n_tokens"] <= r["padded_len"] for r in own)


def test_quality_rules_can_be_filtered(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    judged = quality_rules.quality_rules(docs)
    assert judged.filter("kept").count() == sum(r["kept"] for r in judged.collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_and_packing_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([r for r in rows() if r[0] is not None], DOCS)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.plan(docs).collect()}
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.count() == sum(r["copies"] for r in mixing.plan(docs).collect()) and set(copies.values()) <= {0, 1, 2, 3}
    packed = corpus_pipeline.packing(spark, mixed, str(tmp_path))
    assert packed.count() == mixed.count() and packed.select("batch_id", "slot").distinct().count() == mixed.count()
