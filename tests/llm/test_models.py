"""Scores of the three models against plain versions that read the fitted numbers and nothing else."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import brown_lm, quality_model, toxicity
from ledgerlens.llm.common import Scratch
from ledgerlens.llm.words import Words

DOCS = "doc_id long, text string, lang string"


def tokens(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def hash_of(word):
    return int(Words(pa.array([word])).hashes()[0].view(np.int64))


def held_out(doc_id, folds):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def language(seed=4, n=90):
    rng = random.Random(seed)
    nouns, verbs, rare = [f"n{k}" for k in range(25)], [f"v{k}" for k in range(25)], [f"r{k}" for k in range(400)]
    sentence = lambda: f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(rare) if rng.random() < 0.5 else rng.choice(nouns)}"
    rows = [(k, " ".join(sentence() for _ in range(rng.randint(1, 12))), "en") for k in range(n)]
    return [*rows, (200, None, "en"), (201, "", "en"), (202, "  \n", None), (None, "the n1 v1 unseen word", "en"), (203, "THE N1 V1 A N2", "en"), (203, "THE N1 V1 A N2", "en"), (204, "brand new words only", "en")]


def test_brown_scores_match_a_plain_version(spark):
    rows = language()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    train = [t for i, t, _ in rows if not held_out(i, 10)]
    count = Counter(w for t in train for w in tokens(t))
    scratch = Scratch(spark, "test")
    found = brown_lm.lexicon(docs.filter(brown_lm.fold(brown_lm.F.col("doc_id"), 10) != 0).select("text"), scratch, 20).collect()
    names = {hash_of(w): w for w in count}
    lexicon = {names[r["word"]]: (r["n"], r["class"]) for r in found}
    assert {w: n for w, (n, _) in lexicon.items()} == dict(count)

    size = Counter(c for _, c in lexicon.values())
    mass = Counter()
    for n, c in lexicon.values():
        mass[c] += n
    open_class = max(range(brown_lm.CLASSES), key=lambda c: (size[c], -c))
    line = lambda t: [33, 33, *[lexicon[w][1] if w in lexicon else open_class for w in tokens(t)], 32]
    cells = np.zeros((brown_lm._STATES,) * 3)
    for t in train:
        s = line(t)
        for k in range(2, len(s)):
            cells[s[k - 2], s[k - 1], s[k]] += 1
    steps = brown_lm.witten_bell(cells)
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    got = brown_lm.score_texts(docs, seeds=20, head=30).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        s, w = line(t), tokens(t)
        score = sum(steps[s[k - 2], s[k - 1], s[k]] for k in range(2, len(s)))
        for x in w:
            c = lexicon[x][1] if x in lexicon else open_class
            score += math.log10((count[x] + 0.1) / (mass[c] + 0.1 * (size[c] + 1)))
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w) + math.log10((len(train) + 0.1) / (total + 0.1 * (kinds + 1)))
        want.append((str(i), held_out(i, 10), len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, base, score))
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    seen = [(str(r["doc_id"]), *(r[c] for c in names)) for r in got]
    for a, b in zip(sorted(seen), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_words_join_the_class_of_the_largest_gain():
    rng = np.random.default_rng(3)
    gain = brown_lm.gains(rng.integers(0, 50, (brown_lm._STATES, brown_lm._STATES)))
    word = np.array([5, 5, 5, 9, 12, 12], np.int64)
    cells = []
    seen = {}
    for w in word:
        c = np.zeros(7, brown_lm._CELL)
        c["code"], c["n"] = rng.choice(brown_lm._SIDES, 7, replace=False), rng.integers(1, 9, 7)
        cells.append(c.tobytes())
        v = seen.setdefault(int(w), np.zeros(brown_lm._SIDES))
        v[c["code"]] += c["n"]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(word[a:b]), pa.array(cells[a:b], pa.binary())], ["word", "cells"])
    out = brown_lm._assign(np.array([9], np.uint64), np.array([3]), gain)(iter([batch(0, 2), batch(2, 2), batch(2, 5), batch(5, 6)]))
    got = {w: (n, c) for b in out for w, n, c in zip(*(b.column(x).to_pylist() for x in ("word", "n", "class")))}
    want = {w: (int(v[: brown_lm._STATES].sum()), 3 if w == 9 else int((v @ gain).argmax())) for w, v in seen.items()}
    assert got == want


def blobs(spark):
    rng = random.Random(8)
    pick = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for k in range(160):
        toxic, good = int(k % 4 == 0), int(k % 3 != 0)
        text = pick("the of alpha beta gamma, delta".split() if good else ["X$", "##", "y!!"], 40) + (" vile" + rng.choice(["", "s", "ness"]) if toxic else "")
        rows.append((k, text, "en" if k % 5 else "de"))
        labels.append((k, good, toxic))
    return rows, labels


def test_toxicity_scores_match_a_plain_forward_pass(spark):
    rows, labels = blobs(spark)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert set(model.thresholds) <= {"en", "de"} and all(0 < t < 1 for t in model.thresholds.values())
    texts = [t for _, t, _ in rows[:12]] + ["", "one", "vile"]
    got = model.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        table_rows, _ = toxicity.token_rows(pa.array([text]))
        vectors = [model.table[r].sum(0) for r in table_rows]
        raw = float(model.bias) + model.shift
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [float(model.filter_bias[w][f]) + sum(float(vectors[i + j] @ model.filters[w][j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(w) if i + j < len(vectors)) for i in range(len(vectors))]
                raw += max(0.0, max(values, default=0.0)) * float(model.out[k * toxicity.FILTERS + f])
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-4)
    one = spark.createDataFrame([(k, 1, 1) for k in range(160)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, one).filter("score = 1.0 and predicted = 1").count() == 160
    assert quality_model.score_quality(docs, one).filter("score = 1.0 and predicted = 1").count() == 160


def test_quality_scores_match_plain_densities(spark):
    rows, labels = blobs(spark)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, marks)
    x = quality_model.features(pa.array([t for _, t, _ in rows[:20]] + [None, "", "one"]))
    for own, score in zip(x, model.score(x), strict=True):
        z = (own - model.centre) / model.scale
        density = []
        for mean, factor in zip(model.mean, model.factor, strict=True):
            covariance = np.linalg.inv(factor.T @ factor)
            density.append(-0.5 * ((z - mean) @ np.linalg.solve(covariance, z - mean) + np.linalg.slogdet(covariance)[1]))
        d = density[1] - density[0] + math.log(model.share / (1 - model.share))
        d = math.copysign(math.log1p(abs(d)), d)
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * d + model.shift)))), abs=1e-6)


def test_toxicity_learns_from_long_texts(spark):
    rows, labels = blobs(spark)
    rows = [(k, t + " alpha beta gamma" * 2500 if toxic else t, lang) for (k, t, lang), (_, _, toxic) in zip(rows, labels, strict=True)]
    assert min(len(t) for (_, t, _), (_, _, toxic) in zip(rows, labels, strict=True) if toxic) > 1 << 15
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, marks).collect()}
    assert sum(found[k] == toxic for k, _, toxic in labels) >= 0.9 * len(labels)


def test_toxicity_counts_every_labelled_row_in_any_layout(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["one", "two", "three", "four", "five"]) for _ in range(k % 9)) + (" vile" if k % 3 == 0 else ""), None) for k in range(5200)]
    labels = [(k, int(k % 3 == 0)) for k, _, _ in rows if k % 7]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = [(k, y) for k, y in labels if not held_out(k, toxicity.FOLDS)]
    models = []
    for parts in (1, 6):
        shards = toxicity.deal(docs.repartition(parts), marks, "toxic", Scratch(spark, "test"), 1 << 14).cache()
        assert shards.count() > 3
        counts = toxicity.total(shards, toxicity.Shard.counts)
        assert list(counts[toxicity.ROWS + 1]) == [sum(y == k for _, y in learnt) for k in (0, 1)]
        kept = {i for s in toxicity._shards(shards.toArrow().to_batches()) for i in [(s.number, int(s.kept.sum()), len(s.label))]}
        assert counts[toxicity.ROWS].sum() == sum(n - k for _, k, n in kept)
        at = toxicity.token_rows(pa.array(["vile"]))[0][0]
        assert all(counts[a, 1] == counts[toxicity.ROWS, 1] and counts[a, 0] == 0 for a in at[:1])
        models.append(toxicity.train(docs.repartition(parts), marks, size=1 << 14))
    assert models[0].shift == models[1].shift and np.array_equal(models[0].matrix(), models[1].matrix())
    scores = models[0].score(pa.array([t for _, t, _ in rows]))
    assert all((s >= 0.5) == (k % 3 == 0) for s, (k, _, _) in zip(scores, rows, strict=True))
