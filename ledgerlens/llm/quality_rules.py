"""Operator 1, quality rules: a threshold table compiled into one Spark projection, without user functions.

Everything is per row: no join, no shuffle and no Python worker.  Repeated 8-word windows are found by hashing
(pairs, then fours, then eights of word hashes); only texts in which some window repeats sort their windows.  A row number
holds a caller's filter above the statistics: pushed below them, it would compute each of them many times.

Defined results: a null text counts as an empty one (no words, base_failed); a null id keeps its row; equal rows get
equal results; an empty table gives an empty result; columns other than id and text are not read or returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GAP

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be with de la le les et un une du des que el los las en y se por "
    "der die das und ein eine zu den von mit ist im"
).split()

#: Below so many words a text may lack stop words by chance; its ratio is null and passes.
SURE_WORDS = 40

#: Threshold table of the verdict: (rule, statistic, lowest, highest); a statistic that is null passes.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 20, None),
    ("word_length", "mean_word_chars", 1.5, 25),
    ("symbols", "symbol_ratio", None, 0.2),
    ("stop_words", "stop_word_ratio", 0.005, None),
    ("lines", "dup_line_ratio", None, 0.6),
]


def repeated_positions(order: str) -> Column:
    """Ascending positions of the hashes that occur twice or more in a sorted array of (hash, position)."""
    sides = lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"])
    return F.sort_array(F.transform(F.filter(order, sides), lambda x: x["i"]))


def covered(at: str, width: int) -> Column:
    """Positions inside windows of a width that begin at the ascending positions."""
    step = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda i, j: F.least(F.coalesce(j - i, F.lit(width)), F.lit(width)))
    return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text: words, their characters, symbols, repeated lines, repeated 8-word windows, stop words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.select(
        "doc_id",
        F.filter(F.split("text", GAP), lambda w: w != "").alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # Hashes near the end run over it and are cut off once, at the last step.
    over = lambda of, step: F.zip_with(of, F.slice(of, 1 + step, F.size(of)), lambda a, b: F.xxhash64(a, b))
    rest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    windows = hashed.select(*rest, over("h", 1).alias("h")).select(*rest, over("h", 2).alias("h"))
    windows = windows.select(*rest, F.slice(over("h", 4), 1, F.greatest(F.size("h") - 7, F.lit(0))).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    windows = windows.select(*rest, F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("order"))
    windows = windows.select(*rest, F.when(F.col("order").isNotNull(), repeated_positions("order")).alias("at"))
    counted = windows.select(*rest, F.coalesce(F.when(F.col("at").isNotNull(), covered("at", 8)), F.lit(0).cast("long")).alias("n_repeat_words"), F.monotonically_increasing_id().alias("_row"))
    return counted.filter("_row >= 0").drop("_row")


def compile_rules(rules: list[tuple[str, str, float | None, float | None]]) -> list[Column]:
    """One boolean column for each rule of the table: true where the statistic is inside its limits."""
    made = []
    for name, stat, low, high in rules:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(stat) >= low)
        if high is not None:
            ok = ok & (F.col(stat) <= high)
        made.append(F.coalesce(ok, F.lit(True)).alias(f"rule_{name}"))
    return made


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list | None = None) -> DataFrame:
    """doc_id, counts, ratios, one boolean a rule, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words lie in 8-word windows that the text repeats.
    kept: not base_failed and every rule of the threshold table passes.
    """
    rules = RULES if rules is None else rules
    n = F.nullif(F.col("n_words"), F.lit(0))
    counted = statistics(docs, id_col, text_col).select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0))).alias("symbol_ratio"),
        F.when(F.col("n_words") >= SURE_WORDS, F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_ratio"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    judged = counted.select("*", *compile_rules(rules))
    every = ~F.col("base_failed")
    for name, *_ in rules:
        every = every & F.col(f"rule_{name}")
    return judged.select("*", every.alias("kept"))
