"""Operator 10, toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed table rows: one for the word without outer punctuation, and one for each of its
prefixes of 4 to 6 bytes.  Filters of widths 1 to 3 run over all words of a text, each is max-pooled over the whole
text, and a logistic layer joins them.  The first embedding coordinate starts at the smoothed log odds of a row among
toxic and other training texts; Adam then trains all layers.  Scores and thresholds are calibrated on labelled rows kept
from training, a fifth of each class: a shift makes 0.5 the best threshold of all of them, and each language moves
from there towards its own best threshold, the further the more toxic rows it has (n / (n + PRIOR) of the way in log
odds).  The language picks a threshold and never enters a score.

Every labelled row outside the held-out fold takes part, by its whole text: four fifths of each class in the counts and
the training, the other fifth in the shift and the thresholds.  Rows are dealt by a hash of the id to shards of about
SHARD_BYTES of labelled text, one row each of a scratch table.  In each of EPOCHS rounds every shard trains the model on all
of its rows; the model then moves by the mean of the shards' steps, a table row by the mean over the shards that moved it.
Counts and steps are summed as whole numbers where the shards are, so that neither the layout of the input nor the order
of the tasks changes a sum; only sums of the size of the model reach the driver.  Scores of the kept rows are counted on a
grid of 1 / GRID in log odds.  The model is a few MB whatever the corpus.  Scoring is one Arrow pass over all whole texts:
each filter's products with the tables are computed once, words only look them up.

Defined results: a null text counts as empty; an empty or wordless text has the score of its bias; with labels of one
class or none, every score is 0 (1 if all labels are 1); equal texts have equal scores; a null id counts as held out; a
language that is unknown, or has no toxic or no other row kept from training, has the threshold 0.5; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlens.llm.common import Scratch, fold
from ledgerlens.llm.labels import FOLDS, known_labels, share_of_ones
from ledgerlens.llm.words import U, Words, chunks, constants, mix

#: Labelled text of a shard, and text that is dealt to a shard before its labels are looked up, in bytes.
SHARD_BYTES = 8 << 20
DEALT_BYTES = 64 << 20
#: One labelled row of each class in so many is kept from training.
KEPT = 5
#: Steps of log odds that scores are counted by when thresholds are set.
GRID = 1 << 10
#: Steps of the shards are summed as multiples of 1 / UNIT.
UNIT = 1 << 32
#: Toxic rows at which a language's threshold goes half the way to its own best.
PRIOR = 20
ROWS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS = 4
BATCH = 64
#: Words that end a batch earlier; a longer text is a batch of its own.
BATCH_WORDS = 1 << 20
_PARTS = len(PREFIXES) + 1
_SALT = constants(_PARTS, 9)
_OUTER = np.isin(np.arange(256), list(b".,;:!?*#$%&\"'()[]{}<>|-_"))


def word_rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each distinct word, one column a part, and each word's index among the distinct ones."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        end -= _OUTER[words.data[end - 1]] & (end - start > 1)
        start += _OUTER[words.data[np.minimum(start, len(words.data) - 1)]] & (end - start > 1)
    h = words.hashes(start, end)
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    start, end, h = start[at], end[at], h[at]
    columns = [h * _SALT[0]]
    for k, n in enumerate(PREFIXES, 1):
        columns.append(words.hashes(start, np.minimum(end, start + n)) * _SALT[k])
    return (mix(np.stack(columns, 1) if len(h) else np.zeros((0, _PARTS), np.uint64)) >> U(64 - 16)).astype(np.int32), back.astype(np.int64)


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every word (one row a word) and the first word of each text."""
    words = Words(texts)
    rows, back = word_rows(words)
    return rows[back] if len(back) else np.zeros((0, _PARTS), np.int32), words.first


class Model:
    def __init__(self, share: float):
        rng = np.random.default_rng(11)
        self.constant: float | None = None
        self.table = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.filter_bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        self.shift = 0.0
        self.thresholds: dict[str, float] = {}
        self._products: dict[tuple[int, int], np.ndarray] = {}

    def products(self, w: int, j: int) -> np.ndarray:
        """The table times the j-th slice of a filter of width w, computed once in each process."""
        if (w, j) not in self._products:
            self._products[w, j] = self.table @ self.filters[w][j * DIM : (j + 1) * DIM]
        return self._products[w, j]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_products": {}}

    def matrix(self) -> np.ndarray:
        """All parameters, DIM in a row: the table, then the filters, their biases and the last layer."""
        rest = [*(self.filters[w].ravel() for w in WIDTHS), *(self.filter_bias[w] for w in WIDTHS), self.out, [self.bias]]
        rest = np.concatenate(rest).astype(float)
        return np.concatenate([self.table.astype(float), np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)])

    def load(self, matrix: np.ndarray) -> None:
        self.table = matrix[:ROWS].astype(np.float32)
        rest, at = matrix[ROWS:].ravel().astype(np.float32), 0
        for w in WIDTHS:
            self.filters[w], at = rest[at : at + w * DIM * FILTERS].reshape(w * DIM, FILTERS), at + w * DIM * FILTERS
        for w in WIDTHS:
            self.filter_bias[w], at = rest[at : at + FILTERS], at + FILTERS
        self.out, at = rest[at : at + len(self.out)], at + len(self.out)
        self.bias = rest[at]
        self._products = {}

    def limits(self, langs: pa.Array) -> np.ndarray:
        """The threshold of each row's language."""
        names = pa.array(list(self.thresholds), pa.string())
        at = pc.fill_null(pc.index_in(langs.cast(pa.string()), names), len(names)).to_numpy(zero_copy_only=False)
        return np.append(np.array(list(self.thresholds.values()), float), 0.5)[at]

    def pooled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        rows, back = word_rows(words)
        first, n = words.first, len(words.start)
        full = np.flatnonzero(np.diff(first))
        out = np.zeros((len(words), len(WIDTHS) * FILTERS), np.float32)
        if not n:
            return out, full
        last = np.repeat(first[1:], np.diff(first))
        for k, w in enumerate(WIDTHS):
            value = np.repeat(self.filter_bias[w][None], n, 0)
            for j in range(w):
                own = self.products(w, j)[rows].sum(1)[back]
                if j:
                    own = np.concatenate([own[j:], np.zeros((min(j, n), FILTERS), np.float32)])[:n]
                    own[np.arange(n) + j >= last] = 0
                value += own
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(value, first[:-1][full], axis=0)
        return out, full

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        pooled, _ = self.pooled(texts)
        raw = np.maximum(pooled, 0).astype(float) @ self.out.astype(float) + float(self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.turn = rate, {}, 0

    def step(self, name: str, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
        m, v = self.state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        self.state[name] = m, v
        t = self.turn
        return (value - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


class Shard:
    """Labelled texts as words numbered within the shard, in the order of id, label and text."""

    def __init__(self, number: int, label: bytes, lang: list[str | None], first: bytes, word: bytes, rows: bytes):
        self.number, self.lang = number, lang
        self.label = np.frombuffer(label, np.uint8).astype(int)
        self.first, self.word = np.frombuffer(first, np.int64), np.frombuffer(word, np.int32)
        self.rows = np.frombuffer(rows, np.uint16).reshape(-1, _PARTS).astype(np.int64)
        self.kept = np.zeros(len(self.label), bool)
        for k in (0, 1):
            self.kept[np.flatnonzero(self.label == k)[number % KEPT :: KEPT]] = True

    def words(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of the distinct words of some texts, the number of each word among them, and each text's first word."""
        size = self.first[texts + 1] - self.first[texts]
        first = np.concatenate([[0], np.cumsum(size)])
        word = self.word[np.arange(first[-1]) + np.repeat(self.first[texts] - first[:-1], size)]
        used = np.zeros(len(self.rows), bool)
        used[word] = True
        return self.rows[used], (np.cumsum(used) - 1)[word], first

    def batches(self, texts: np.ndarray) -> Iterator[np.ndarray]:
        total = np.cumsum(self.first[texts + 1] - self.first[texts])
        at = 0
        while at < len(texts):
            last = np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_WORDS, "right")
            yield texts[at : (at := min(at + BATCH, max(at + 1, int(last))))]

    def counts(self) -> np.ndarray:
        """Training texts of each class that have a table row, and below them all training texts, then all texts."""
        out = np.zeros((ROWS + 2, 2), np.int64)
        for part in self.batches(np.flatnonzero(~self.kept)):
            rows, word, first = self.words(part)
            pair = np.unique(np.repeat(np.arange(len(part)), np.diff(first)) * max(1, len(rows)) + word)
            text, word = pair // max(1, len(rows)), pair % max(1, len(rows))
            pair = np.unique((text * ROWS)[:, None] + rows[word])
            np.add.at(out, (pair % ROWS, self.label[part][pair // ROWS]), 1)
        out[ROWS], out[ROWS + 1] = (np.bincount(y, minlength=2) for y in (self.label[~self.kept], self.label))
        return out


def _logits(model: Model, rows: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores of some texts, pooled values, the first word of each pooled window, and vectors of the distinct words."""
    n, size = len(word), np.diff(first)
    vector = model.table[rows].sum(1)
    last = np.repeat(first[1:], size)
    pooled, at = np.zeros((len(size), len(WIDTHS) * FILTERS), np.float32), np.zeros((len(size), len(WIDTHS) * FILTERS), np.int64)
    for k, w in enumerate(WIDTHS):
        value = np.repeat(model.filter_bias[w][None], n, 0)
        for j in range(min(w, n)):
            own = (vector @ model.filters[w][j * DIM : (j + 1) * DIM])[word[j:]]
            own[np.arange(j, n) >= last[: n - j]] = 0
            value[: n - j] += own
        here = slice(k * FILTERS, (k + 1) * FILTERS)
        for i in np.flatnonzero(size):
            at[i, here] = first[i] + value[first[i] : first[i + 1]].argmax(0)
            pooled[i, here] = value[at[i, here], np.arange(FILTERS)]
    return np.maximum(pooled, 0) @ model.out + model.bias, pooled, at, vector


def start(counts: np.ndarray, share: float) -> Model:
    """The model before training, from the counts of all shards."""
    model = Model(share)
    n, every = counts[ROWS], counts[ROWS + 1]
    if not every.all():
        model.constant = float(every[1] > 0)
        return model
    count, seen = counts[:ROWS].T, np.maximum(n, 1)
    odds = np.log((count[1] + 0.5) / (seen[1] + 1)) - np.log((count[0] + 0.5) / (seen[0] + 1))
    sure = count[1] >= 2
    model.table[:, 0] = np.where(sure, np.clip(odds, 0, 5), 0) / _PARTS
    for k, w in enumerate(WIDTHS):
        for j in range(w):
            model.filters[w][j * DIM, 0] = 1.0 / w
        model.filters[w][:, 1:] *= 0.5
        model.out[k * FILTERS] = 1.0 if w == 1 else 0.2
    model.bias = np.float32(-2.5)
    return model


def learn(model: Model, shard: Shard, classes: np.ndarray, turn: int) -> None:
    """One round over all training rows of a shard; classes: the weight of a row of either class."""
    adam, rng = _Adam(0.01), np.random.default_rng([5, turn, shard.number])
    for part in shard.batches(rng.permutation(np.flatnonzero(~shard.kept))):
        rows, word, first = shard.words(part)
        raw, pooled, at, vector = _logits(model, rows, word, first)
        y = shard.label[part]
        slope = (classes[y] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(part)).astype(np.float32)
        adam.turn += 1
        active = (pooled > 0) * model.out[None] * slope[:, None]
        grad_out = np.maximum(pooled, 0).T @ slope + 1e-4 * model.out
        grads, table_rows, table_grads = {}, [], []
        for k, w in enumerate(WIDTHS):
            here = slice(k * FILTERS, (k + 1) * FILTERS)
            grads[w] = np.zeros_like(model.filters[w])
            for j in range(w):
                d, f = np.nonzero((active[:, here] != 0) & (at[:, here] + j < first[1:][:, None]))
                g, found = active[:, here][d, f][:, None], word[at[:, here][d, f] + j]
                np.add.at(grads[w][j * DIM : (j + 1) * DIM].T, f, vector[found] * g)
                table_rows.append(rows[found])
                table_grads.append(model.filters[w][j * DIM : (j + 1) * DIM].T[f] * g)
        model.out = adam.step("out", model.out, grad_out)
        model.bias = np.float32(adam.step("bias", np.array([model.bias]), np.array([slope.sum()]))[0])
        for k, w in enumerate(WIDTHS):
            model.filters[w] = adam.step(f"f{w}", model.filters[w], grads[w] + 1e-5 * model.filters[w])
            model.filter_bias[w] = adam.step(f"b{w}", model.filter_bias[w], active[:, k * FILTERS : (k + 1) * FILTERS].sum(0))
        r, g = np.concatenate(table_rows), np.concatenate(table_grads)
        np.add.at(model.table, r.reshape(-1), -0.5 * np.repeat(g, _PARTS, 0))  # plain steps for the few rows that were pooled


def _step(model: Model, classes: np.ndarray, turn: int) -> Callable[[Shard], np.ndarray]:
    def step(shard: Shard) -> np.ndarray:
        own = deepcopy(model)
        learn(own, shard, classes, turn)
        by = np.rint((own.matrix() - model.matrix()) * UNIT).astype(np.int64)
        return np.concatenate([by, by.any(1)[:, None].astype(np.int64)], 1)

    return step


def _best(at: np.ndarray, clean: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, between two steps of the grid that have rows."""
    order = np.argsort(-at, kind="stable")
    at, hit, wrong = at[order], np.cumsum(weight[1] * toxic[order]), np.cumsum(weight[0] * clean[order])
    top = (2 * hit / (hit + wrong + hit[-1])).argmax()
    high = at[top] / GRID
    low = (at[top + 1] + 1) / GRID if top + 1 < len(at) else high - 2.0
    return float((high + max(low, high - 4.0)) / 2)


def _kept_scores(model: Model):
    """How many rows of either class were kept from training, by language and raw score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            for part in shard.batches(np.flatnonzero(shard.kept)):
                raw = _logits(model, *shard.words(part))[0].astype(float)
                at = np.floor(np.clip(raw, -64, 64) * GRID).astype(np.int32)
                y = shard.label[part].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang[i] for i in part], pa.string()), pa.array(at), pa.array(1 - y), pa.array(y)], ["lang", "at", "clean", "toxic"])

    return score


def _calibrate(model: Model, shards: DataFrame, share: float, scratch: Scratch) -> None:
    """Shift raw scores so that 0.5 is the best F1 threshold at the corpus's share; then a threshold a language."""
    found = shards.mapInArrow(_kept_scores(model), "lang string, at int, clean long, toxic long")
    found = scratch.put(found.groupBy("lang", "at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "scores")
    every = found.groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, clean, toxic = (every[c].to_numpy() for c in ("at", "clean", "toxic"))
    truth = toxic.sum() / max(1, toxic.sum() + clean.sum())
    weight = np.array([(1 - share) / max(1 - truth, 1e-6), share / max(truth, 1e-6)])

    def by_lang(rows: pa.Table) -> pa.Table:
        own = [rows[c].to_numpy() for c in ("at", "clean", "toxic")]
        both = rows.slice(0, 1 if own[1].any() and own[2].any() else 0).select(["lang"])
        return both.append_column("toxic", pa.array([own[2].sum()] * len(both), pa.int64())).append_column("best", pa.array([_best(*own, weight)] * len(both) if len(both) else [], pa.float64()))

    model.shift = -_best(at, clean, toxic, weight) if toxic.any() else 0.0
    for r in found.filter("lang != ''").groupBy("lang").applyInArrow(by_lang, "lang string, toxic long, best double").orderBy("lang").collect():
        moved = np.clip(r["best"] + model.shift, -30, 30) * r["toxic"] / (r["toxic"] + PRIOR)
        model.thresholds[r["lang"]] = float(1 / (1 + np.exp(-moved)))
    scratch.drop(found)


SHARD = "shard int, label binary, lang array<string>, first binary, word binary, rows binary"


def _shard_row(docs: pa.Table, labels: pa.Table) -> pa.Table:
    """One row with all labelled texts of a shard; no row if there are none."""
    rows = docs.join(labels.drop_columns("shard"), "doc_id", join_type="inner").sort_by([(c, "ascending") for c in ("doc_id", "label", "text", "lang")])
    first, ids, kinds = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], np.zeros((0, _PARTS), np.int32)
    for batch in rows.combine_chunks().to_batches():
        for a, b in chunks(batch, "text"):
            words = Words(batch.column("text").slice(a, b - a))
            own, back = word_rows(words)
            first.append(words.first[1:] + first[-1][-1])
            ids.append(back + len(kinds))
            kinds = np.concatenate([kinds, own])
    _, at, back = np.unique(np.ascontiguousarray(kinds, np.uint16).view(np.uint64).ravel(), return_index=True, return_inverse=True)
    data = [rows["label"].to_numpy().astype(np.uint8), np.concatenate(first), back[np.concatenate(ids)].astype(np.int32), kinds[at].astype(np.uint16)]
    label, first, word, kinds = (pa.array([x.tobytes()], pa.binary()) for x in data)
    made = [docs["shard"].slice(0, 1).combine_chunks().cast(pa.int32()) if len(docs) else pa.array([0], pa.int32()), label, pa.array([rows["lang"].to_pylist()], pa.list_(pa.string())), first, word, kinds]
    return pa.table(made, ["shard", "label", "lang", "first", "word", "rows"]).slice(0, min(1, len(rows)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(len(batch)):
            row = [batch.column(c)[i] for c in ("label", "first", "word", "rows")]
            label, first, word, rows = (x.as_buffer() for x in row)
            yield Shard(batch.column("shard")[i].as_py(), label, batch.column("lang")[i].as_py(), first, word, rows)


def deal(docs: DataFrame, labels: DataFrame, label: str, scratch: Scratch, size: int = SHARD_BYTES) -> DataFrame:
    """A scratch table of all labelled rows outside the held-out fold, one row a shard."""
    known = known_labels(labels, label)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    rows = rows.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    texts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    share = min(1.0, known.count() / max(1, texts["n"]))
    n = int(max(1, np.ceil(texts["bytes"] * share / size), np.ceil(texts["bytes"] / DEALT_BYTES)))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("shard")
    both = [x.select("*", number).groupBy("shard") for x in (rows, known)]
    return scratch.put(both[0].cogroup(both[1]).applyInArrow(_shard_row, SHARD), "shards")


def total(shards: DataFrame, measure: Callable[[Shard], np.ndarray]) -> np.ndarray:
    """Sum of whole numbers of one shape over all shards: added up in each task, then by row."""
    shape = measure(Shard(0, b"", [], np.zeros(1, np.int64).tobytes(), b"", b"")).shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(shape, np.int64)
        for shard in _shards(batches):
            found += measure(shard)
        at = np.flatnonzero(found.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(found[at, k]) for k in range(shape[1]))], ["at", *names])

    names = [f"v{k}" for k in range(shape[1])]
    rows = shards.mapInArrow(add, ", ".join(["at int", *(f"{c} long" for c in names)])).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros(shape, np.int64)
    out[rows["at"].to_numpy()] = np.stack([rows[c].to_numpy() for c in names], 1)
    return out


def _scorer(model: Model, columns: list[str]):
    """Batches of the named columns with the score of the text and the threshold of its language appended."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, "text"):
                value, limit = model.score(batch.column("text").slice(a, b - a)), model.limits(batch.column("lang").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), pa.array(value), pa.array(limit)], [*columns, "_score", "_limit"])

    return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", size: int = SHARD_BYTES) -> Model:
    """Fit on all labelled rows outside the held-out fold."""
    scratch, share = Scratch(docs.sparkSession, "toxicity"), share_of_ones(labels, label)
    shards = deal(docs, labels, label, scratch, size)
    counts = total(shards, Shard.counts)
    model = start(counts, share)
    if model.constant is None:
        n = counts[ROWS]
        classes = 0.5 / np.maximum(n / max(1, n.sum()), 1e-6)
        for turn in range(EPOCHS):
            step = total(shards, _step(model, classes, turn))
            model.load(model.matrix() + step[:, :DIM] / UNIT / np.maximum(step[:, DIM:], 1))
        _calibrate(model, shards, share, scratch)
    scratch.drop(shards)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and flagged (score at or over its language's threshold)."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    scored = rows.mapInArrow(_scorer(model, ["doc_id"]), "doc_id long, _score double, _limit double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), (F.col("_score") >= F.col("_limit")).alias("flagged")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that score under the threshold of their language.

    Each row is judged by its own text, so rows of a repeated or null id are not mixed up, and no join moves the texts.
    """
    model = train(docs, labels)
    scored = docs.mapInArrow(_scorer(model, docs.columns), StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_limit", DoubleType())]))
    return scored.filter(F.col("_score") < F.col("_limit")).select(*docs.columns)
