"""Operator 9, LM scoring with Brown class-based n-grams.

Tokens are the lower-cased words of a text and one end.  Passes over the texts, each an Arrow pass with sums by key:

1. Each task names its NAMED most frequent training words; the SEEDS words of the largest sums are the seeds.
2. Bigram counts among the seeds.  On the driver, exchange clustering moves seeds between CLASSES classes while the class
   bigram likelihood grows.  The matrix has a size that the parameter fixes.
3. The lexicon, every training word with its count and class: tasks count the seed classes (or end, or any other word)
   left and right of each word; rows of one word meet, and the word joins the class that raises the same class bigram
   likelihood most (its first-order gain).  So every word is classed by its contexts, however many words there are.
4. Each text as classes: the HEAD most frequent words are broadcast with class and count (a fixed size); every other
   word of every text meets the lexicon in a join, so none is left out.
5. Class trigram counts of all training tokens, smoothed by Witten-Bell down to bigrams, unigrams and a uniform share.
6. Scores: log10 P(class | two classes before) + log10 P(word | class).

The base score is that of the contract.  What is gathered, the lexicon, grows with the corpus.

Defined results: a null or empty text is one end token; a null id counts as the empty text, whose remainder is 0, so it is
held out; a word without a count has the class of most words; without training texts every count is 0; equal texts have
equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, fold
from ledgerlens.llm.words import Index, U, Words, chunks

FOLDS = 10
SEEDS = 1500
NAMED = 8 * SEEDS
CLASSES = 32
HEAD = 1 << 16
ROUNDS = 8
#: Additive smoothing of words within their class, and of class bigrams in the gain of a word.
ALPHA = 0.1
SMOOTH = 0.5
_END = CLASSES  # the class of the end token; CLASSES + 1 stands before a text
_STATES = CLASSES + 2
_OTHER = CLASSES + 1  # as a neighbour: any word that is no seed
_SIDES = 2 * (CLASSES + 2)
_TAIL = 255  # in a text's classes: a word outside of the head
#: Distinct words, and word contexts, that a task holds before it passes their counts on.
FLUSH = 1_500_000
_CELL = np.dtype([("code", "u1"), ("n", "<u4")])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the NAMED most frequent words of a task."""
    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for a, b in chunks(batch, "text"):
            own, times = np.unique(Words(batch.column("text").slice(a, b - a)).hashes(), return_counts=True)
            h, back = np.unique(np.concatenate([h, own]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, times])).astype(np.int64)
            if len(h) > FLUSH:  # words far from the top so far
                kept = np.argpartition(-n, FLUSH // 2)[: FLUSH // 2]
                h, n = h[kept], n[kept]
    top = np.argsort(-n, kind="stable")[:NAMED]
    yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top])], ["word", "n"])


def _bigrams(seeds: np.ndarray):
    """Counts of pairs of seeds, end and all others: a square matrix of fixed size in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, size = Index(seeds), len(seeds) + 2
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for a, b in chunks(batch, "text"):
                words = Words(batch.column("text").slice(a, b - a))
                at = index(words.hashes()).astype(np.int64)
                at[at < 0] = size - 1
                line, _ = with_ends(at, words.first, size - 2)
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size) if len(line) > 1 else 0
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return count


def with_ends(at: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in one line, an end before the first text and after each, and each text's first token."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + 1)]) + 1
    line = np.full(begin[-1], end, np.int64)
    line[np.arange(len(at)) + np.repeat(begin[:-1] - first[:-1], n)] = at
    return line, begin


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Classes of the first words of a bigram count matrix, whose last two rows (end, other words) keep their own.

    Each word moves to the class that raises the class bigram likelihood
    sum N(c, d) log N(c, d) - sum N(c, .) log N(c, .) - sum N(., d) log N(., d) most, until no word moves.
    """
    words = len(pairs) - 2
    k = classes + 2
    assigned = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    pairs = pairs.astype(float)
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), assigned] = 1
    right, left = pairs @ member, (pairs.T @ member)  # right[w, c]: w before class c; left[w, c]: class c before w
    table = member.T @ right
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    out, into = pairs.sum(1), pairs.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a, own = assigned[w], pairs[w, w]
            r, s = right[w].copy(), left[w].copy()
            r[a] -= own
            s[a] -= own
            table[a, :] -= r
            table[:, a] -= s
            table[a, a] -= own
            base_out, base_into = table.sum(1), table.sum(0)
            c = slice(0, classes)
            gain = (f(table[c] + r) - f(table[c])).sum(1) + (f(table[:, c] + s[:, None]) - f(table[:, c])).sum(0)
            d = np.diag(table)[c]
            gain += f(d + r[c] + s[c] + own) - f(d + r[c]) - f(d + s[c]) + f(d)
            gain -= f(base_out[c] + out[w]) - f(base_out[c]) + f(base_into[c] + into[w]) - f(base_into[c])
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = int(a)
            table[best, :] += r
            table[:, best] += s
            table[best, best] += own
            if best != a:
                moved += 1
                right[:, a] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, best] += pairs[w]
                assigned[w] = best
        if moved <= words // 500:
            break
    return assigned[:words]


def gains(table: np.ndarray) -> np.ndarray:
    """First-order gain of the class bigram likelihood for each neighbour (left, then right) and class."""
    smooth = table.astype(float) + SMOOTH
    after = np.log(smooth / smooth.sum(1, keepdims=True))  # after[c, d]: d follows c
    before = np.log(smooth / smooth.sum(0, keepdims=True))  # before[d, c]: d stands before c
    return np.concatenate([before[:, :CLASSES], after[:CLASSES].T])


def _contexts(seeds: np.ndarray, classes: np.ndarray):
    """(word, cells) of the words of a task's texts: how often each neighbour class stands left and right of a word."""

    def merged(held: list) -> tuple[np.ndarray, ...]:
        h, code, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((code, h))
        h, code, n = h[order], code[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])]))
        return h[head], code[head], np.add.reduceat(n, head)

    def passed(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        cells = np.empty(len(h), _CELL)
        cells["code"], cells["n"] = code, n
        ends = (np.append(head, len(h)) * _CELL.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cells.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), packed], ["word", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size = Index(seeds), [], 0
        for batch in batches:
            for a, b in chunks(batch, "text"):
                words = Words(batch.column("text").slice(a, b - a))
                h, back = np.unique(words.hashes(), return_inverse=True)
                if not len(h):
                    continue
                at = index(h)
                kind = np.where(at >= 0, classes[np.maximum(at, 0)], _OTHER)[back]
                line, begin = with_ends(kind, words.first, _END)
                place = np.arange(len(kind)) + np.repeat(begin[:-1] - words.first[:-1], np.diff(words.first))
                code = np.concatenate([back * _SIDES + line[place - 1], back * _SIDES + _STATES + line[place + 1]])
                cell, n = np.unique(code, return_counts=True)
                held.append((h[cell // _SIDES], (cell % _SIDES).astype(np.uint8), n))
                size += len(cell)
                if size > FLUSH:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield passed(*held[0])
                        held, size = [], 0
        if held:
            yield passed(*merged(held))

    return count


def _assign(seeds: np.ndarray, classes: np.ndarray, gain: np.ndarray):
    """(word, n, class) from contexts whose rows of one word come one after the other."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last, carried = Index(seeds), np.zeros(0, np.int64), np.zeros((0, _SIDES))

        def told(word: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            at = index(word.view(np.uint64))
            kind = np.where(at >= 0, classes[np.maximum(at, 0)] if len(classes) else 0, (seen @ gain).argmax(1))
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen[:, :_STATES].sum(1).astype(np.int64)), pa.array(kind.astype(np.int32))], ["word", "n", "class"])

        for batch in batches:
            word, packed = batch.column("word").to_numpy(), batch.column("cells")
            if not len(word):
                continue
            flat = b"".join(x.as_py() for x in packed)
            cells = np.frombuffer(flat, _CELL)
            length = np.array([len(x) for x in packed.to_pylist()]) // _CELL.itemsize
            row = np.cumsum(np.concatenate([[True], word[1:] != word[:-1]])) - 1
            seen = np.bincount(np.repeat(row, length) * _SIDES + cells["code"], weights=cells["n"], minlength=(row[-1] + 1) * _SIDES).reshape(-1, _SIDES)
            word = word[np.concatenate([[True], word[1:] != word[:-1]])]
            if len(last) and last[0] == word[0]:
                seen[0] += carried[0]
            elif len(last):
                yield told(last, carried)
            if len(word) > 1:
                yield told(word[:-1], seen[:-1])
            last, carried = word[-1:], seen[-1:].copy()
        if len(last):
            yield told(last, carried)

    return assign


def histories(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class trigram cell of every token, ends included, in order, and the first token of each text."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + 3)])
    line = np.full(begin[-1], _STATES - 1, np.int64)
    line[np.arange(len(c)) + np.repeat(begin[:-1] + 2 - first[:-1], n)] = c
    line[begin[1:] - 1] = _END
    cell = (line[:-2] * _STATES + line[1:-1]) * _STATES + line[2:] if len(line) > 2 else np.zeros(0, np.int64)
    real = np.ones(len(line), bool)
    real[begin[:-1]] = real[begin[:-1] + 1] = False
    return cell[real[2:]], np.concatenate([[0], np.cumsum(n + 1)])


def witten_bell(count: np.ndarray) -> np.ndarray:
    """log10 P(z | x, y) from trigram counts [x, y, z]; no mass is given to the state before a text."""
    count = count.astype(float)
    count[:, :, _STATES - 1] = 0
    allowed = np.ones(_STATES)
    allowed[_STATES - 1] = 0

    def back_off(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds, total = (n > 0).sum(-1, keepdims=True), n.sum(-1, keepdims=True)
        return np.where(total + kinds > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)

    p = back_off(count.sum((0, 1)), allowed / allowed.sum())
    p = back_off(count.sum(0), np.broadcast_to(p, (_STATES, _STATES)))
    p = back_off(count, np.broadcast_to(p, (_STATES,) * 3))
    return np.log10(np.maximum(p, 1e-300))


def _per_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


class Head:
    """The most frequent words with count and class, and the smoothing of every class."""

    def __init__(self, word: np.ndarray, n: np.ndarray, kind: np.ndarray, class_n: np.ndarray, class_v: np.ndarray):
        self.word, self.n, self.kind = word, n, kind
        self.floor = np.log10(class_n + ALPHA * (class_v + 1))
        self.open = int(class_v.argmax())
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def code(self, texts: pa.Array) -> list[pa.Array]:
        """n_tokens, known head tokens, base and emission sums of head tokens, classes, tail words and their places."""
        if self._index is None:
            self._index = Index(self.word)
        words = Words(texts)
        first = words.first
        h, back = np.unique(words.hashes(), return_inverse=True)
        at = self._index(h)
        is_head = at >= 0
        n = np.where(is_head, self.n[np.maximum(at, 0)], 0) if len(self.n) else np.zeros(len(h), np.int64)
        kind = np.where(is_head, self.kind[np.maximum(at, 0)], _TAIL) if len(self.n) else np.full(len(h), _TAIL)
        base = np.where(is_head, np.log10(n + 0.1), 0.0)
        own = np.where(is_head, np.log10(n + ALPHA) - self.floor[np.where(is_head, kind, 0)], 0.0)
        tail = np.flatnonzero(~is_head[back]) if len(h) else np.zeros(0, np.int64)
        text_of = words.text_of
        pairs, place = np.unique(text_of[tail] * max(1, len(h)) + back[tail], return_inverse=True)
        begin = np.searchsorted(pairs // max(1, len(h)), np.arange(len(words) + 1))
        token = np.searchsorted(tail, first)
        ends = lambda x: pa.array(x.astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(kind[back].astype(np.uint8).tobytes())])
        return [
            pa.array(np.diff(first) + 1), pa.array(_per_text(is_head[back], first).astype(np.int64)), pa.array(_per_text(base[back], first)), pa.array(_per_text(own[back], first)), packed,
            pa.ListArray.from_arrays(ends(begin), pa.array(h[pairs % max(1, len(h))].view(np.int64))), pa.ListArray.from_arrays(ends(token), ends(place - begin[text_of[tail]])),
        ]


def _coder(head: Head):
    names = ["row", "doc_id", "n_tokens", "known", "base", "own", "classes", "tails", "places"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(b - a)), batch.column("doc_id").slice(a, b - a), *head.code(batch.column("text").slice(a, b - a))], names)
                row += b - a

    return code


def _resolver(head: Head):
    """Classes of all tokens and the sums of tail tokens, from what the lexicon knows of each text's tail words."""
    names = ["doc_id", "n_tokens", "known", "base", "own", "classes"]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            length = batch.column("tails_n").to_numpy()
            begin = np.concatenate([[0], np.cumsum(length)])
            n, kind = np.zeros(begin[-1], np.int64), np.full(begin[-1], head.open)
            found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "kind")}
            for r in range(size):
                if found["at"][r] is not None and len(found["at"][r]):
                    at = begin[r] + np.asarray(found["at"][r])
                    n[at], kind[at] = found["n"][r], found["kind"][r]
            places, coded = batch.column("places"), batch.column("classes").to_pylist()
            count = np.diff(places.offsets.to_numpy())
            flat = places.values.to_numpy()[places.offsets[0].as_py() : places.offsets[-1].as_py()]
            which = np.repeat(begin[:-1], count) + flat
            line = np.frombuffer(b"".join(coded), np.uint8).copy()
            line[line == _TAIL] = kind[which]
            first = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
            token = np.concatenate([[0], np.cumsum(count)])
            packed = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(line.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_tokens"), pa.array(batch.column("known").to_numpy() + _per_text(n[which] > 0, token).astype(np.int64)),
                    pa.array(batch.column("base").to_numpy() + _per_text(np.log10(n[which] + 0.1), token)),
                    pa.array(batch.column("own").to_numpy() + _per_text(np.log10(n[which] + ALPHA) - head.floor[kind[which]], token)), packed,
                ],
                names,
            )

    return resolve


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch and the first token of each text."""
    coded = batch.column("classes").to_pylist()
    return np.frombuffer(b"".join(coded), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in coded], dtype=np.int64)])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_STATES**3, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(histories(*_lines(batch))[0], minlength=_STATES**3)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])


def _scorer(steps: np.ndarray):
    names = ["doc_id", "n_tokens", "known", "base", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, begin = histories(*_lines(batch))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(batch.column("own").to_numpy() + _per_text(steps[cell], begin))], names)

    return score


def _counts(cells: DataFrame, size: int) -> np.ndarray:
    """A vector of counts from rows (cell, n); the parameter fixes its size."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    made = np.zeros(size)
    made[found["cell"].to_numpy().astype(np.int64)] = found["n"].to_numpy().astype(np.int64)
    return made


def lexicon(texts: DataFrame, scratch: Scratch, seeds: int = SEEDS) -> DataFrame:
    """word, n, class of every word of the texts."""
    named = texts.mapInArrow(_named, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = scratch.put(named, "named").orderBy(F.desc("n"), "word").limit(seeds).toArrow()
    few = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    size = len(few) + 2
    pairs = _counts(texts.mapInArrow(_bigrams(few), "cell long, n long"), size * size).reshape(size, size)
    classes = exchange(pairs, CLASSES, ROUNDS)
    member = np.zeros((size, _STATES))
    member[np.arange(size), np.concatenate([classes, [_END, _OTHER]])] = 1
    gain = gains(member.T @ pairs @ member)
    met = texts.mapInArrow(_contexts(few, classes), "word long, cells binary").repartition("word").sortWithinPartitions("word")
    return scratch.put(met.mapInArrow(_assign(few, classes, gain), "word long, n long, class int"), "lexicon")


def head_of(words: DataFrame, most: int) -> pa.Table:
    """The most frequent words, at most so many: all words from the least count that leaves no more of them.

    The count is read off a histogram of at most 4096 bins an octave, so no task orders the words.
    """
    n = F.col("n")
    low = F.when(n <= 4096, n).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(n / 4096.0) * 4096) / 4096) * 4096))
    bins = words.groupBy(low.cast("long").alias("low")).agg(F.count("*").alias("k")).orderBy(F.desc("low")).collect()
    least, held = None, 0
    for b in bins:
        held += b["k"]
        if held > most:
            break
        least = b["low"]
    return words.filter(low.cast("long") >= (least if least is not None else 1 << 62)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    scratch = Scratch(docs.sparkSession, "brown")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learnt = fold(F.col("doc_id"), FOLDS) != 0
    texts = rows.filter(learnt).select("text")
    ends = texts.count()
    words = lexicon(texts, scratch, seeds)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    total, kinds = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    top = head_of(words, head)
    known = Head(top["word"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64), top["class"].to_numpy().astype(np.int64), class_n, class_v)

    schema = "row long, doc_id long, n_tokens long, known long, base double, own double, classes binary, tails array<long>, places array<int>"
    coded = scratch.put(rows.mapInArrow(_coder(known), schema), "coded")
    tail = coded.select("row", F.posexplode("tails").alias("at", "word")).join(words, "word").groupBy("row").agg(F.collect_list(F.struct("at", "n", F.col("class").alias("kind"))).alias("found"))
    joined = coded.join(tail, "row", "left").select("doc_id", "n_tokens", "known", "base", "own", "classes", "places", F.size("tails").alias("tails_n"), "found.at", "found.n", "found.kind")
    resolved = scratch.put(joined.mapInArrow(_resolver(known), "doc_id long, n_tokens long, known long, base double, own double, classes binary"), "resolved")
    scratch.drop(coded, words)
    steps = witten_bell(_counts(resolved.filter(learnt).mapInArrow(_trigrams, "cell long, n long"), _STATES**3).reshape((_STATES,) * 3)).reshape(-1)
    out = resolved.mapInArrow(_scorer(steps), "doc_id long, n_tokens long, known long, base double, score double")
    tokens, floor = F.col("n_tokens"), float(np.log10(total + 0.1 * (kinds + 1)))
    return out.select(
        "doc_id", (~learnt).alias("held_out"), "n_tokens", (F.col("known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(ends + 0.1))) - tokens * F.lit(floor)).alias("base_score"), "score",
    )
