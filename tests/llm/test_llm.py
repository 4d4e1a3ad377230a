"""Operators against brute force on small fixtures with nulls, empties, long texts, ties and repeated rows."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import brown_lm, extract, fingerprint, mixing, near_dedup, packing, quality_model, quality_rules, sharding, toxicity
from ledgerlens.llm.words import Index, Words, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts[3] = None
    texts[4] = ""
    texts[5] = " \n\t\x0b "
    texts[6] = "one two three"
    texts[7] = texts[8]
    texts[9] = texts[10] + " extra"
    texts[11] = texts[12].upper()
    texts[13] = "line a\nline a\n\nline b\nline a " * 30
    texts[14] = "x" * 30000
    texts[15] = " ".join(vocabulary) * 40
    return [(i, t, "en", ["s0", "s1", None, "s2"][i % 4] if i % 3 else "s0", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_the_pattern():
    texts = [t for _, t, *_ in corpus()] + ["Äb\x0bÇ a", "a", " a"]
    w = Words(pa.array(texts))
    got = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    want = [x.encode().lower() for t in texts for x in words(t)]
    assert got == want and len(np.unique(w.hashes())) == len(set(want))
    index = Index(np.unique(w.hashes())[::2])
    assert ((index(w.hashes()) >= 0) == np.isin(w.hashes(), index.keys)).all()


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t, *_ in corpus():
        w = words(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeated))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_rules_ignore_clashing_columns(docs):
    clash = docs.withColumn("kept", F.lit("x")).withColumn("h", F.lit(1)).withColumn("n_words", F.lit(1)).withColumn("size", F.lit("y")).withColumn("target", F.lit("z"))
    assert quality_rules.quality_rules(clash).filter("kept").count() == quality_rules.quality_rules(docs).filter("kept").count()
    assert mixing.plan(clash).agg(F.sum("taken")).first()[0] == mixing.plan(docs).agg(F.sum("taken")).first()[0]
    assert mixing.emit(clash).columns == clash.columns


def test_packing_is_optimal_and_whole(docs, empty, spark):
    rng = np.random.default_rng(2)
    size = np.sort(rng.choice(60, 12, replace=False)) + 1
    count = rng.integers(1, 9, 12)
    cost = lambda cuts: sum((count[(size <= b) & (size > a)] * (b - size[(size <= b) & (size > a)])).sum() for a, b in zip([0, *cuts[:-1]], cuts))
    best = min(cost([*c, size[-1]]) for k in range(4) for c in itertools.combinations(size[:-1], k))
    assert cost(packing.best_bounds(count, count * size, size, 4)) == best
    rows = packing.pack(docs.union(docs.limit(3)), budget=256, buckets=4).collect()
    assert len(rows) == docs.count() + 3
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r["batch_id"]), key=lambda r: r["batch_id"]):
        own = list(own)
        assert len({r["padded_len"] for r in own}) == 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["padded_len"] <= 256
        assert all(r["n_tokens"] <= r["padded_len"] for r in own)
    assert packing.pack(empty).count() == 0


def blobs(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "of", "alpha", "beta", "gamma.", "delta"]) for _ in range(60)) for _ in range(120)]
    bad = ["ab ab ab ab " * 20 if k % 2 else "A$$$ B### C!! " * 20 for k in range(60)]
    toxic = [g.replace("alpha", "vileone" + rng.choice(["", "s", "ing"]), 1) for g in good[:60]]
    texts = [(g, 1, 0) for g in good] + [(b, 0, 0) for b in bad] + [(x, 1, 1) for x in toxic]
    rows = [(i, t, "en", "s", len(t)) for i, (t, *_) in enumerate(texts)]
    labels = [(i, q, x) for i, (_, q, x) in enumerate(texts)]
    return spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "xx", None, 0)], DOCS), spark.createDataFrame([*labels, (902, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, empty):
    docs, labels = blobs(spark)
    for scored, name in ((quality_model.score_quality(docs, labels), "quality"), (toxicity.score_toxicity(docs, labels), "toxic")):
        rows = scored.join(labels, "doc_id", "left").collect()
        assert len(rows) == 242 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        held = [r for r in rows if r["held_out"] and r[name] is not None]
        assert sum(r["predicted"] == r[name] for r in held) / len(held) >= 0.9
    none = labels.limit(0)
    assert quality_model.score_quality(docs, none).filter("score = 0.5").count() == 242
    assert toxicity.score_toxicity(docs, none).filter("score = 0").count() == 242
    assert quality_model.score_quality(empty, labels).count() == 0 and toxicity.score_toxicity(empty, labels).count() == 0


def test_extraction(spark):
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">x</a></nav><div class="ad">buy</div><div id="cookie-notice">accept</div>'
        "<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text.</p><div class='share'>share me</div><p>Caf&eacute;</p><section class='comments'><p>nice</p></section></article>"
        "<aside>side</aside><form>f</form><footer>&copy; f</footer></body></html>"
    )
    assert extract.extract(page) == "A & B First bold text. Café"
    plain = "<body><div class='menu'><a>m</a></div>" + "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(5)) + "<div class='footer'>f</div></body>"
    assert extract.extract(plain) == " ".join(f"{'word ' * 30}{k}." for k in range(5)).replace("  ", " ")
    assert extract.extract(None) == extract.extract("") == extract.extract("<p></p>") == "" and extract.extract("cut <p>off &lt;") == "cut off <"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None), (None, "v", "<p>" + html.escape("ü<" * 5000) + "</p>")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in extract.extract_pages(rows).collect())
    assert got == [(0, 10000), (1, 27), (2, 0), (2, 0)]


def components(texts):
    sets = []
    for t in texts:
        w = [x.encode().lower() for x in words(t)]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root, [len(s) for s in sets]


def test_near_dedup_is_exact(spark, empty):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    texts = [t for _, t, *_ in corpus(40)]
    for k in range(80):  # near copies of one text at many distances, and a chain of edits
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = list(base[::-1])
    for k in range(25):
        chain[(k * 5) % 150] = f"c{k}"
        texts.append(" ".join(chain))
    want, sizes = components(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in got)
    assert near_dedup.near_dedup(empty).count() == 0
    odd = near_dedup.near_dedup(spark.createDataFrame([(None, "a b", "", "", 0), (5, "a b", "", "", 0), (5, "a b", "", "", 0)], DOCS)).collect()
    assert sorted(str(r["component_id"]) for r in odd) == ["5", "5", "None"]


def test_signature_of_small_sets_is_filled():
    value, begin = shingles(Words(pa.array(["a b c d e f", "a"])), 5)
    s = near_dedup.one_permutation(np.concatenate([np.sort(value[begin[i] : begin[i + 1]]) for i in range(2)]), begin)
    assert s.shape == (2, near_dedup.BINS) and (s[1] == s[1][0]).all() and set(s[0]) == set(value[: begin[1]])


def test_mixing(docs, empty):
    rows = mixing.plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, total = {}, set(order), sum(sizes.values())
    while True:  # reshare by weight until none is above
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert sorted(mixing.plan(docs).collect(), key=str) == sorted(rows, key=str)
    emitted = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert all(emitted[r["doc_id"]] == r["copies"] for r in rows) and mixing.plan(empty).count() == 0


def test_sharding(spark, docs, empty, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k), 4)
    before = store.manifest()
    old = sorted(store.read().collect(), key=str)
    version = store.compact(1 << 20)
    now = store.manifest()
    assert now["version"] == version > before["version"] and len(now["runs"]) < len(before["runs"]) and sorted(store.read().collect(), key=str) == old
    with pytest.raises(sharding.Conflict):
        store.commit(now["version"] - 1, [], now["schema"])
    rows = sharding.shard_rows(store).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} <= {r["name"] for r in now["runs"]}
    merges, rest = sharding.plan([{"name": str(k), "bytes": b} for k, b in enumerate([12, 13, 11, 14, 12, 90, 3])], 40)
    assert sorted(r["bytes"] for r in rest) == [3, 90] and all(len(m) > 1 for m in merges)
    assert sharding.compacted(empty, str(tmp_path / "e")).read().count() == 0


def test_fingerprints(spark, docs, empty):
    rows = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t, *_ in corpus()]
    assert len(rows) == len(texts)
    for i, (r, t) in enumerate(zip(rows, texts)):
        h = len(t) // 2
        edited = t[: len(t) - h] + texts[(i + 1) % len(texts)][:h]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert rows[7]["fingerprint"] == rows[8]["fingerprint"] and rows[7]["near_next"] == 1 and rows[4]["fingerprint"] == ""
    twice = fingerprint.fingerprints(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and sum(r["near_next"] == 1 for r in twice) >= len(texts)
    assert fingerprint.fingerprints(empty).count() == 0
    a = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    h = [r["code"] for r in fingerprint.anchor_table(a).first()["anchors"]]
    assert h and len(h) <= 5


def test_language_model(docs, empty):
    rows = {r["doc_id"]: r for r in brown_lm.score_texts(docs).collect()}
    token = {i: [x.encode().lower() for x in words(t)] + [None] for i, t, *_ in corpus()}
    count = Counter(x for i, w in token.items() if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = sum(count.values()), len(count)
    for i, w in token.items():
        r = rows[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n) and r["score"] < 0
    assert brown_lm.score_texts(empty).count() == 0


def test_exchange_separates_languages():
    rng = np.random.default_rng(1)
    pairs = np.zeros((22, 22))
    for side in (0, 10):
        pairs[side : side + 10, side : side + 10] = rng.integers(20, 40, (10, 10))
    c = brown_lm.exchange(pairs, 2, 10)
    assert len(set(c[:10])) == 1 and len(set(c[10:])) == 1 and c[0] != c[10]
    p = 10 ** brown_lm.witten_bell(rng.integers(0, 3, (brown_lm._STATES,) * 3))
    assert np.allclose(p.sum(-1), 1, atol=1e-6)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels = blobs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows, names = source, [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "toxicity", "near_dedup", "mixing", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, rows, str(tmp_path))
        assert kept.columns == P.COLUMNS and ids(kept) <= ids(rows) and kept.count() > 0, name
        kept.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    assert len(ids(rows) & toxic) <= 6 and len(ids(rows)) >= 100
    assert P.run(spark, str(tmp_path)).count() == mixing.emit(rows).count()


def test_pipeline_dedup_of_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as P

    same = "a b c d e f g"
    rows = [(5, same, "", "", 0), (5, same, "", "", 0), (6, "h i j k l m", "", "", 0), (7, same, "", "", 0), (None, "x", "", "", 0)]
    kept = P.dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert kept.columns == P.COLUMNS and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "6", "None"]
