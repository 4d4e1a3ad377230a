"""Operator 3, quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives a vector of statistics (lengths, repetition, letter case, symbols, punctuation, stop words) in
one Arrow pass.  Each class has a mean and a covariance shrunk towards the pooled one and towards a multiple of the
identity; Cholesky factors of both are cached, and the score is a logistic map of the difference of the Mahalanobis log
densities.  The model is fitted on at most SAMPLE labelled rows of either class (a parameter); statistics and scores
cover every row.

Defined results: a null text counts as empty; an empty or wordless text has the statistics 0 and a score of its own;
with labels of one class or none, every score is that class's share (0.5 without labels); equal texts have equal
scores; a null id counts as held out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold
from ledgerlens.llm.labels import FOLDS, sample_labels, share_of_ones
from ledgerlens.llm.quality_rules import STOP_WORDS
from ledgerlens.llm.words import Index, Words, chunks

#: Most labelled rows of either class that the model is fitted on.
SAMPLE = 10_000
#: Shrinkage tried: share of the pooled covariance, share of the scaled identity.
GRID = [(p, i) for p in (0.0, 0.1, 0.3) for i in (0.005, 0.05)]

_MASKS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "letter": np.isin(np.arange(256), np.concatenate([np.arange(65, 91), np.arange(97, 123)])),
    "symbol": np.isin(np.arange(256), list(b"#*$%&<>@^~=_+\\{}[]")),
    "bar": np.isin(np.arange(256), list(b"|")),
    "bang": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "line": np.isin(np.arange(256), [10]),
}
FEATURES = ["log_words", "word_bytes", "adjacent", "distinct", "frequent", "stop_words", "upper", "symbol", "bar", "bang", "stop", "digit", "line"]
_STOPS = None


def features(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    global _STOPS
    if _STOPS is None:
        _STOPS = Index(np.unique(Words(pa.array([" ".join(sorted(set(STOP_WORDS)))])).hashes()))
    words = Words(texts)
    h, first = words.hashes(), words.first
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]).astype(float)

    count = {k: per_text(mask[words.raw], words.at) for k, mask in _MASKS.items()}
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n > 0]] = False
    distinct, frequent = np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(n):
        s = np.sort(h[first[i] : first[i + 1]])
        run = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), [len(s)]]))
        distinct[i], frequent[i] = len(run), run.max()
    size = per_text(~words.space, words.at)
    root = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return np.stack(
        [
            np.log1p(n),
            np.log1p(size / some),
            root(per_text(same, first), n),
            np.log1p(n) - np.log1p(distinct),
            root(frequent, n),
            root(per_text(_STOPS(h) >= 0, first), n),
            root(count["upper"], count["letter"]),
            root(count["symbol"], size),
            root(count["bar"], n),
            root(count["bang"], n),
            root(count["stop"], n),
            root(count["digit"], size),
            root(count["line"], n),
        ],
        axis=1,
    )


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors and a logistic map of their log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, pooled: float, identity: float):
        self.share, self.slope, self.shift = share, 1.0, 0.0
        self.plain = len(np.unique(y)) < 2
        if self.plain:
            return
        self.centre, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - self.centre) / self.scale
        inner = [np.cov(z[y == k].T, bias=True).reshape(z.shape[1], -1) if (y == k).sum() > 1 else np.eye(z.shape[1]) for k in (0, 1)]
        both = sum(c * (y == k).sum() for k, c in enumerate(inner)) / len(y)
        self.mean, self.factor, self.log_det = [], [], []
        for k, c in enumerate(inner):
            mixed = (1 - pooled) * c + pooled * both
            mixed = (1 - identity) * mixed + identity * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
            lower = np.linalg.cholesky(mixed)
            self.mean.append(z[y == k].mean(0))
            self.factor.append(np.linalg.inv(lower))
            self.log_det.append(2 * np.log(np.diag(lower)).sum())

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, with the classes' shares, drawn in at both ends."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(1) + d) for m, f, d in zip(self.mean, self.factor, self.log_det, strict=True)]
        prior = np.log(np.clip(self.share, 1e-6, 1 - 1e-6) / np.clip(1 - self.share, 1e-6, 1))
        d = density[1] - density[0] + prior
        return np.sign(d) * np.log1p(np.abs(d))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the label on the difference, by Newton steps with a small penalty."""
        d = self.difference(x)
        a = np.stack([d, np.ones(len(d))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = a.T @ (weight * (p - y)) + 1e-3 * (w - [1, 0])
            curve = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(curve, slope)
        if np.isfinite(w).all() and w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(x), float(self.share))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Discriminant:
    """The model of the least log loss, over the grid, on the half that it was not fitted on; then fitted on all."""
    if len(np.unique(y)) < 2:
        return Discriminant(x, y, share, 0, 0)
    weight = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    best, least = GRID[-1], np.inf
    half = np.arange(len(y)) % 2 == 0
    if min((y[half] == k).sum() for k in (0, 1)) > 1 and min((y[~half] == k).sum() for k in (0, 1)) > 1:
        for grid in GRID:
            loss = 0.0
            for part in (half, ~half):
                model = Discriminant(x[part], y[part], share, *grid)
                model.calibrate(x[~part], y[~part], weight[~part])
                p = np.clip(model.score(x[~part]), 1e-6, 1 - 1e-6)
                loss -= (weight[~part] * np.where(y[~part] == 1, np.log(p), np.log(1 - p))).sum()
            if loss < least:
                best, least = grid, loss
    model = Discriminant(x, y, share, *best)
    model.calibrate(x, y, weight)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            x = features(batch.column("text").slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )


def _scorer(model: Discriminant):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, "text"):
                value = model.score(features(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(value)], ["doc_id", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, label: str = "quality") -> Discriminant:
    """Fit on the labelled sample: only its statistics, at most 2 * each short vectors, reach the driver."""
    picked = sample_labels(labels, label, each)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    found = rows.select("doc_id", "label", "text").mapInArrow(_features, "doc_id long, label int, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], int), share_of_ones(labels, label))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, each: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels, each)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
