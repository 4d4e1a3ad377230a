"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.quality_model import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.mixing import plan

    mixed = plan(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.sharding import compacted, shard_rows

    store = compacted(table(spark, sf_dir, "documents"), Scratch(spark, "shards").root)
    return shard_rows(store)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.brown_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_quality_model": op3_quality_model,
    "op4_extraction": op4_extraction,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_brown_lm": op9_brown_lm,
    "op10_toxicity": op10_toxicity,
}

#: Words of a text in DuckDB; a null text has none.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT r, i, md5(array_to_string(w[i:i+7], ' ')) AS k FROM g),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM h) WHERE c > 1),
q AS (SELECT r, sum(least(coalesce(j - i, 8), 8)) AS rep FROM p GROUP BY r),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: list_contains(STOPS, x))) AS n_stop
  FROM d LEFT JOIN q USING (r)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 1.5 AND 25, true)
   AND coalesce(n_symbols / nullif(word_chars, 0) <= 0.2, true)
   AND (n_words < 40 OR n_stop / n_words >= 0.005)
   AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.6, true)) AS kept
FROM b
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM s),
c AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::BIGINT AS pool,
  (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS weight_left
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(pool / weight_left, source_size / weight) AS level FROM c WHERE pool / weight_left * weight <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least((3 * source_size)::DOUBLE, level * weight), 0.0) AS target FROM c, f),
r AS (SELECT d.*, source_size, target, target / nullif(source_size, 0) AS rate,
  ('0x' || substr(md5('mix:' || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  coalesce(floor(rate) + (u < rate - floor(rate))::INT, 0)::BIGINT * size AS taken FROM r
"""


def oracle() -> dict[str, str]:
    from ledgerlens.llm.quality_rules import STOP_WORDS

    stops = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"
    return {"op1_quality_rules": OP1_SQL.replace("STOPS", stops), "op6_mixing": OP6_SQL}
