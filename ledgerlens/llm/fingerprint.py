"""Operator 8, document fingerprints from closed syncmers, in DataFrame functions only.

A text's units are its words, long ones cut into pieces of 16 characters, with characters of scripts written without
spaces standing alone.  A k-mer is K units in a row; its inner substrings are its runs of S units, ordered by hash.  It
is a closed syncmer if its least inner substring is its first or its last: a choice that depends on the k-mer alone, so
an edit moves no anchor outside of it.  (Units are words since character k-mers in DataFrame functions cost several times
what the check tool allows; the README has the figures.)

An anchor is a syncmer's position and hash.  Each anchor is printed as a link: a hash of its own code, of the code of the
anchor before it and of the distance between both.  So a link matches where two texts hold the same two anchors equally
far apart, wherever the passage stands in either text.  A fingerprint holds the links of all anchors in text order,
without a bound on their number; the likeness of two fingerprints is the share of their distinct links that both hold.

The next document is found in one move of the texts: rows are dealt to ranges of (doc_id, hash of the text), each range
holds a copy of the first row of the range after it, and a window inside the range reads the next row.  Range bounds are
keys of rows, sampled from a table of keys; at most MOST of them reach the driver.

Defined results: a null text counts as empty; a text of 1 to K - 1 units has one anchor, its sequence; an empty or blank
text has an empty fingerprint; two empty fingerprints are alike (1.0), an empty and a full one are not (0.0).  The next
document follows by ascending doc_id, rows of equal id by the hash of their text; after the last row comes the first;
a null id comes first; a row that occurs several times is followed by its own copy, except the last of them.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

K = 6
S = 2
HEX = 10
#: Thai, kana and Han ranges stand alone.
UNIT = r"[^\x20\x09-\x0D฀-๿぀-ヿ㐀-鿿]{1,16}|[฀-๿぀-ヿ㐀-鿿]"
#: Most ranges, and keys sampled for each of them.
MOST = 1 << 16
SAMPLED = 16


def unit_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))


def with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with a column of anchors, the (position, code) of the closed syncmers of the text, in order."""
    rest = [F.col(c) for c in rows.columns]
    last = K - S  # the last inner substring of a k-mer
    hashed = rows.select(*rest, unit_hashes(F.col(text)).alias("_h"))
    # Substrings near the end run over it; the last S - 1 are never an edge or inside of a whole k-mer.
    inner = hashed.select("*", F.transform("_h", lambda x, i: F.xxhash64(x, *[F.get("_h", i + j) for j in range(1, S)])).alias("_s"))

    def code(x: Column, i: Column) -> Column:
        edge = F.least(x, F.get("_s", i + last))
        closed = i + K <= F.size("_h")
        for j in range(1, last):
            closed = closed & (edge <= F.get("_s", i + j))
        return F.when(closed, F.struct(i.alias("position"), F.xxhash64(*[F.get("_s", i + j) for j in range(0, K, S)]).alias("code")))

    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64("_h").alias("code")))
    found = F.when(F.size("_h") >= K, F.array_compact(F.transform("_s", code))).when(F.size("_h") > 0, whole).otherwise(F.slice(whole, 1, 0))
    return inner.select(*rest, found.alias(name))


def with_links(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with a column of links, the leading 40 bits of each, in text order."""
    rest = [F.col(c) for c in rows.columns]

    def link(a: Column, i: Column) -> Column:
        before = F.get("_a", i - 1)
        return F.shiftrightunsigned(F.xxhash64(a["code"], before["code"], a["position"] - before["position"]), 64 - 4 * HEX)

    return with_anchors(rows, text, "_a").select(*rest, F.transform("_a", link).alias(name))


def spelled(links: str) -> Column:
    return F.array_join(F.transform(links, lambda x: F.lower(F.lpad(F.hex(x), HEX, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of the distinct links of both texts that both hold."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and anchors (position and code, in order) of every text, for positional matching."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_anchors(rows, "text", "anchors").drop("text")


def order_key(doc_id: Column, text: Column) -> Column:
    """Text that sorts like (doc_id, nulls first, hash of the text)."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), digits(F.coalesce(doc_id.bitwiseXOR(F.lit(-(1 << 63))), F.lit(0).cast("long"))), digits(F.xxhash64(text)))


def range_bounds(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """Least keys of about so many ranges of about equal size, ascending; every one is the key of a row."""
    modulus = 1 << 20
    share = max(1, min(modulus, SAMPLED * ranges * modulus // max(1, rows)))
    sampled = keys.filter(F.pmod(F.xxhash64("key"), F.lit(modulus)) < share).select("key")
    found = sorted(r["key"] for r in sampled.limit(4 * SAMPLED * ranges).collect())
    first = keys.agg(F.min("key")).first()[0]
    step = max(1, len(found) // max(1, ranges))
    return sorted({first, *found[step::step]}) if first is not None else []


def range_of(key: Column, bounds: Column, n: int) -> Column:
    """Number of the last bound that is not over the key, by binary search."""

    def step(state: Column, _: Column) -> Column:
        middle = ((state["low"] + state["high"] + 1) / 2).cast("int")
        over = F.get(bounds, middle) > key
        return F.struct(F.when(over, state["low"]).otherwise(middle).alias("low"), F.when(over, middle - 1).otherwise(state["high"]).alias("high"))

    turns = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.lit(n - 1).alias("high")), step, lambda s: s["low"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), order_key(F.col(id_col).cast("long"), text).alias("key"))
    keys = scratch.put(whole.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    n, most = keys.agg(F.count("*"), F.max("copies")).first()
    bounds = range_bounds(keys, n, min(MOST, n, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))) or [""]
    listed = F.split(F.lit(",".join(bounds)), ",")

    once = whole.withColumn("copies", F.lit(1).cast("long"))
    if (most or 0) > 1:  # repeated rows are counted; they are the only ones whose texts meet by key
        again = keys.filter("copies > 1").select("key")
        met = whole.join(again, "key", "left_semi").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
        once = whole.join(again, "key", "left_anti").withColumn("copies", F.lit(1).cast("long")).select("doc_id", "text", "key", "copies").union(met.select("doc_id", "text", "key", "copies"))
    placed = once.withColumn("range", range_of(F.col("key"), listed, len(bounds)))
    # The first row of each range also ends the range before it, under a key that is over all others.
    own = F.struct(F.col("range").alias("at"), F.col("key").alias("place"), F.lit(True).alias("real"))
    end = F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("at"), F.lit("2").alias("place"), F.lit(False).alias("real"))
    turned = F.when(F.col("key") == F.get(listed, F.col("range")), F.array(own, end)).otherwise(F.array(own))
    dealt = with_links(placed.select("doc_id", "text", "copies", F.inline(turned)).repartition("at"), "text", "links")
    following = Window.partitionBy("at").orderBy("place")
    pairs = dealt.select("*", F.lead("text").over(following).alias("next_text"), F.lead("links").over(following).alias("next_links")).filter("real")
    if (most or 0) > 1:
        turn = lambda t, p, k: F.struct(F.col(t).alias("next_text"), F.col(p).alias("next_links"), k.alias("times"))
        turns = F.when(F.col("copies") > 1, F.array(turn("next_text", "next_links", F.lit(1).cast("long")), turn("text", "links", F.col("copies") - 1)))
        turned = pairs.withColumn("turn", F.explode(F.coalesce(turns, F.array(turn("next_text", "next_links", F.lit(1).cast("long"))))))
        pairs = turned.select("doc_id", "text", "links", "turn.next_text", "turn.next_links", F.explode(F.sequence(F.lit(1), F.col("turn.times").cast("int"))).alias("_"))

    sized = pairs.select("doc_id", "text", "links", "next_text", "next_links", F.length("text").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = sized.select("doc_id", "links", "next_links", "n_chars", F.concat(F.left("text", F.col("n_chars") - half), F.left("next_text", half)).alias("edited"))
    linked = with_links(edited, "edited", "edited_links")
    return linked.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spelled("links").alias("fingerprint"), spelled("edited_links").alias("edited_fingerprint"),
        likeness("links", "edited_links").alias("near_edited"), likeness("links", "next_links").alias("near_next"),
    )
