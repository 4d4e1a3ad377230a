"""Fingerprints against a brute-force version."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprint

K, S = fingerprint.K, fingerprint.S


def hash64(*parts):
    """Spark's xxhash64 of text, longs and ints: each hash seeds the next; null leaves the seed as it is."""
    seed = 42
    for kind, value in parts:
        if value is not None:
            data = value.encode() if kind == "text" else struct.pack("<q" if kind == "long" else "<i", value)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def links(text):
    units = [hash64(("text", u)) for u in re.findall(fingerprint.UNIT, text)]
    inner = [hash64(*[("long", x) for x in units[i : i + S]]) for i in range(len(units))]
    found = []
    for i in range(len(units) - K + 1):
        window = inner[i : i + K - S + 1]
        if min(window) in (window[0], window[-1]):
            found.append((i, hash64(*[("long", inner[i + j]) for j in range(0, K, S)])))
    if 0 < len(units) < K:
        found = [(0, hash64(*[("long", x) for x in units]))]
    made = []
    for n, (at, code) in enumerate(found):
        before = found[n - 1] if n else None
        made.append((hash64(("long", code), ("long", before and before[1]), ("int", before and at - before[0])) % (1 << 64)) >> 24)
    return made


def near(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def brute(rows):
    """Results by (doc_id, hash of the text, nulls first), each row followed by the next of the list, the last by the first."""
    ordered = sorted(((i is not None, i or 0, hash64(("text", t or "")) % (1 << 64), t or "") for i, t in rows))
    made = []
    for at, (known, i, _, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = links(text), links(edited), links(after)
        made.append((i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:010x}" for x in a), "".join(f"{x:010x}" for x in b), near(a, b), near(a, c)))
    return made


def texts():
    sentence = "the quick brown fox jumps over the lazy dog while seven wizards play chess in the garden of an old king "
    rows = [(k, " ".join(sentence.split()[(k * j) % 7 :: 1 + (j % 2)][0] + str((k * j) % 11) for j in range(5 + 9 * k))) for k in range(25)]
    rows += [(25, None), (26, ""), (27, " \t\n"), (28, "one two"), (29, "漢字かな交じり ไทย " + "𝒳" * 40), (30, sentence * 300), (31, "z" * 9000), (32, rows[3][1]), (33, rows[3][1])]
    rows += [(None, "no id"), (None, sentence), (40, "tie b " * 9), (40, "tie a " * 9), (41, sentence), (41, sentence), (41, sentence), (-5, "negative id first")]
    return rows


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_match_brute_force(spark, partitions):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, links string, key double").repartition(partitions)
    got = fingerprint.fingerprints(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_fingerprints_of_small_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], schema)).collect()
    assert [tuple(r) for r in one] == brute([(7, "a b c d e f g h")]) and one[0]["near_next"] == 1.0
    anchors = fingerprint.anchor_table(spark.createDataFrame([(7, "a b c d e f g h i j")], schema)).select(F.explode("anchors.position").alias("p")).collect()
    assert [r["p"] for r in anchors] == sorted({r["p"] for r in anchors})
