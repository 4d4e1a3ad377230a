"""Exact statistics of the columns of a wide matrix (wallet and one double a feature), as passes over its partitions.

A pass hands each partition's columns to numpy and returns counts or sums, a few rows a column, so that neither the values
nor their long form are sorted or moved.  Only distinct values and pairs of features move: packed, once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of the columns that one task of pairs may hold.
PAIR_BYTES = 256 << 20
#: Below so many values in open intervals, the next pass counts whole values.
FEW = 1 << 20
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def wide_form(matrix: DataFrame) -> DataFrame:
    """A long matrix (wallet, feature, value) as a wide one; a wide one as it is."""
    if set(matrix.columns) != {"wallet", "feature", "value"}:
        return matrix
    names = sorted(r["feature"] for r in matrix.select("feature").distinct().collect())
    return matrix.groupBy("wallet").agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])


def names_of(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c != "wallet"]


def to_keys(v: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order; zeros are one."""
    b = (v + 0.0).view(np.int64)
    return b ^ ((b >> np.int64(63)) & _FLIP)


def from_keys(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return (k ^ ((k >> np.int64(63)) & _FLIP)).view(np.float64)


def _each(wide: DataFrame, names: list[str], one: Callable[[int, np.ndarray], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """one(column number, its values without nulls) of every column of every partition; the columns of `schema` behind `column`."""
    kinds = pa.schema([("column", pa.int32()), *[(f.split()[0], {"long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        for c in range(len(names)) if held else ():
            v = np.concatenate([b.column(c).drop_null().to_numpy(zero_copy_only=False) for b in held])
            got = one(c, v) if len(v) else None
            if got is not None:
                size = len(next(iter(got.values())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, c, np.int32)), *[pa.array(got[f.name], f.type) for f in list(kinds)[1:]]], schema=kinds)

    return wide.select(*[F.col(f"`{n}`").cast("double") for n in names]).mapInArrow(run, f"column int, {schema}")


def _cells(wide: DataFrame, names: list[str], shift: int, above: int, inside: dict[int, np.ndarray]) -> pd.DataFrame:
    """column, cell, n, low, high: values by the leading bits of their keys, within the named cells of the pass before."""

    def one(c: int, v: np.ndarray) -> dict[str, np.ndarray] | None:
        k = to_keys(v)
        if inside:
            k = k[np.isin(k >> np.int64(above), inside[c])] if c in inside else k[:0]
        if not len(k):
            return None
        k.sort()
        cell = k >> np.int64(shift)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        last = np.r_[first[1:], len(k)]
        return {"cell": cell[first], "n": last - first, "low": k[first], "high": k[last - 1]}

    rows = _each(wide, names, one, "cell long, n long, low long, high long").groupBy("column", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return rows.toPandas().sort_values(["column", "cell"])


def quantiles(wide: DataFrame, names: list[str], shares: tuple[float, ...], of: Callable[[str, np.ndarray], np.ndarray] | None = None) -> dict[str, tuple[int, list[float]]]:
    """Values known and the exact quantiles, interpolated at (n - 1) share, of every column that has values; `of` maps the
    two values beside a quantile before they are interpolated.

    Each pass counts values by more leading bits, only in the cells that hold a wanted rank, until such a cell has one value:
    what comes to the driver is a row a cell, whatever the number of wallets.
    """
    known: dict[int, int] = {}
    want: dict[int, dict[int, float | None]] = {}
    below: dict[tuple[int, int], int] = {}  # values before a cell
    inside: dict[int, np.ndarray] = {}
    above, shift = 64, 48
    while True:
        found = _cells(wide, names, shift, above, inside)
        left, cells = 0, {}
        for c, rows in found.groupby("column"):
            c = int(c)
            cell, n, low, high = (rows[k].to_numpy() for k in ("cell", "n", "low", "high"))
            if c not in known:
                known[c] = int(n.sum())
                want[c] = {r: None for p in shares for r in (math.floor((known[c] - 1) * p), math.ceil((known[c] - 1) * p))}
            start = np.empty(len(cell), np.int64)
            parent = cell >> np.int64(above - shift) if above < 64 else np.zeros(len(cell), np.int64)
            for at in np.unique(parent):
                own = parent == at
                start[own] = below.get((c, int(at)), 0) + np.r_[0, np.cumsum(n[own])[:-1]]
            open_ = set()
            for rank in [r for r, v in want[c].items() if v is None]:
                i = int(np.flatnonzero((start <= rank) & (rank < start + n))[0])
                if low[i] == high[i]:
                    want[c][rank] = float(from_keys(low[i : i + 1])[0])
                else:
                    open_.add(i)
            if open_:
                cells[c] = np.array(sorted(int(cell[i]) for i in open_), np.int64)
                left += int(n[list(open_)].sum())
                below |= {(c, int(cell[i])): int(start[i]) for i in open_}
        if not cells:
            break
        below = {(c, at): below[c, at] for c, own in cells.items() for at in own.tolist()}
        inside, above = cells, shift
        shift = 0 if left <= FEW else max(0, shift - 12)
    made = {}
    for c, n in known.items():
        value = lambda rank, c=c: want[c][rank] if of is None else float(of(names[c], np.array([want[c][rank]]))[0])
        q = []
        for p in shares:
            at = (n - 1) * p
            low, high = math.floor(at), math.ceil(at)
            q.append(value(low) if low == high or want[c][low] == want[c][high] else (high - at) * value(low) + (at - low) * value(high))
        made[names[c]] = (n, q)
    return made


def modes(wide: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """Rows with the most frequent value, and distinct values, of every column that has values; a partition sends each
    distinct value once."""

    def one(_: int, v: np.ndarray) -> dict[str, np.ndarray]:
        key, n = np.unique(to_keys(v), return_counts=True)
        return {"key": key, "n": n}

    rows = _each(wide, names, one, "key long, n long").groupBy("column", "key").agg(F.sum("n").alias("n")).groupBy("column").agg(F.max("n").alias("top"), F.count("*").alias("values"))
    return {names[r["column"]]: (r["top"], r["values"]) for r in rows.collect()}


def counts_where(wide: DataFrame, names: list[str], tests: dict[str, list[Callable[[np.ndarray], np.ndarray]]]) -> dict[str, list[int]]:
    """How many values of a column pass each of its tests."""
    most = max((len(t) for t in tests.values()), default=0)

    def one(c: int, v: np.ndarray) -> dict[str, np.ndarray] | None:
        own = tests.get(names[c])
        return None if own is None else {f"t{i}": np.array([own[i](v).sum() if i < len(own) else 0]) for i in range(most)}

    if not most:
        return {}
    rows = _each(wide, names, one, ", ".join(f"t{i} long" for i in range(most))).groupBy("column").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(most)])
    return {names[r["column"]]: [r[f"t{i}"] for i in range(len(tests[names[r["column"]]]))] for r in rows.collect()}


def moments(wide: DataFrame, names: list[str], of: Callable[[str, np.ndarray], np.ndarray]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every mapped column that has values; partitions are merged by their own means."""

    def one(c: int, v: np.ndarray) -> dict[str, np.ndarray]:
        t = of(names[c], v)
        mean = t.mean()
        return {"n": np.array([len(t)]), "mean": np.array([mean]), "square": np.array([((t - mean) ** 2).sum()]), "low": np.array([t.min()]), "high": np.array([t.max()])}

    rows = _each(wide, names, one, "n long, mean double, square double, low double, high double").toPandas()
    made = {}
    for c, own in rows.groupby("column"):
        n, mean, square = (own[k].to_numpy(float) for k in ("n", "mean", "square"))
        whole = float((n * mean).sum() / n.sum())
        flat = own["low"].min() == own["high"].max()
        made[names[int(c)]] = (float(own["low"].min()) if flat else whole, 0.0 if flat else math.sqrt(float((square + n * (mean - whole) ** 2).sum() / n.sum())))
    return made


def complete_covariance(wide: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariance of ddof 1) of the rows that have all columns; partitions are merged by their own means."""
    p = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(p)]) for b in batches]
        x = np.concatenate(held) if held else np.empty((0, p))
        if len(x := x[~np.isnan(x).any(1)]):
            mean = x.mean(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([((x - mean).T @ (x - mean)).tobytes()], pa.binary())], ["n", "mean", "square"])

    rows = wide.select(*[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(run, "n long, mean binary, square binary").collect()
    n, mean, square = 0, np.zeros(p), np.zeros((p, p))
    for r in rows:
        m, own, spread = r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]).reshape(p, p)
        gap = own - mean
        square = square + spread + np.outer(gap, gap) * n * m / (n + m)
        mean, n = mean + gap * m / (n + m), n + m
    return n, mean, square / max(1, n - 1)


def pair_covariance(wide: DataFrame, names: list[str]) -> list[tuple[str, str, float | None]]:
    """(l, r, covariance of ddof 1) of every two columns, over the rows that have both; values are scaled, so plain sums do."""
    p = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(p)])
            known = ~np.isnan(x)
            x, k = np.where(known, x, 0.0), known.astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([k.T @ k, x.T @ k, x.T @ x]).tobytes()], pa.binary())], ["sums"])

    total = np.zeros((3, p, p))
    for r in wide.select(*[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(run, "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"]).reshape(3, p, p)
    n, s, xy = total
    return [(a, b, float((xy[i, j] - s[i, j] * s[j, i] / n[i, j]) / (n[i, j] - 1)) if n[i, j] > 1 else None) for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2) if n[i, j] > 0]


def _ranks(x: np.ndarray, order: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean ranks of the values of x within the mask, by the order of all of them."""
    own = order[mask[order]]
    v = x[own]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    last = np.r_[first[1:], len(v)]
    out = np.empty(len(x))
    out[own] = np.repeat((first + last + 1) / 2, last - first)
    return out[mask]


def _unit(v: np.ndarray) -> tuple[np.ndarray, bool]:
    """Centred values over their length, and whether they have a spread."""
    if len(v) < 2 or v.min() == v.max():
        return v, False
    v = v - v.mean()
    size = math.sqrt(float(v @ v))
    return (v / size, True) if size > 0 else (v, False)


def _pairs_of(x: list[np.ndarray], left: list[int], right: list[int], same: bool) -> Iterator[tuple[int, int, int, float | None, float | None]]:
    """(i, j, n, pearson, spearman) of each column on the left with each on the right; columns with equal gaps are ranked together."""
    known = [~np.isnan(v) for v in x]
    order = [np.flatnonzero(k)[np.argsort(v[k], kind="stable")] for v, k in zip(x, known, strict=True)]
    gaps: dict[bytes, int] = {}
    group = [gaps.setdefault(np.packbits(k).tobytes(), i) for i, k in enumerate(known)]
    for g, h in itertools.product(sorted({group[i] for i in left}), sorted({group[j] for j in right})):
        mask = known[g] & known[h]
        n = int(mask.sum())
        mine, other = [i for i in left if group[i] == g], [j for j in right if group[j] == h]
        if not n or (same and not any(i < j for i in mine for j in other)):
            continue
        unit = {i: (_unit(x[i][mask]), _unit(_ranks(x[i], order[i], mask))) for i in {*mine, *other}}
        for i, j in itertools.product(mine, other):
            if not same or i < j:
                yield (i, j, n, *[float(a @ b) if ok and fine else None for (a, ok), (b, fine) in zip(unit[i], unit[j], strict=True)])


def correlations(wide: DataFrame, left: list[str], right: list[str] | None = None) -> DataFrame:
    """l, r, n, pearson, spearman of every two columns of left, or of each of left with each of right, over the wallets that
    have both.

    Columns are dealt in blocks to tasks of block pairs, packed by partition; the blocks are small enough that a task holds
    PAIR_BYTES.  Within a task a column is sorted once, however many columns it meets.
    """
    rows = wide.count()
    at_once = max(2, PAIR_BYTES // (8 * max(1, rows)))
    deal = lambda names, size: [names[i : i + size] for i in range(0, len(names), size)]
    if right is None:
        size = max(1, min(at_once // 2, -(-len(left) // 8)))
        blocks = deal(sorted(left), size)
        tasks = [(blocks[i], blocks[j] if i != j else None) for i in range(len(blocks)) for j in range(i, len(blocks))]
    else:
        tasks = [(own, right) for own in deal(sorted(left), max(1, min(at_once - len(right), -(-len(left) // 16))))]
    names = sorted({*left, *(right or [])})
    spot = {n: i for i, n in enumerate(names)}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        x = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(names))]
        for t, (a, b) in enumerate(tasks):
            data = np.stack([x[spot[n]] for n in (*a, *(b or []))]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([data], pa.binary())], ["task", "data"])

    def solved(t: int, data: list[bytes]) -> pa.RecordBatch:
        a, b = tasks[t]
        own, here = [*a, *(b or [])], list(range(len(a)))
        pieces = [np.frombuffer(d).reshape(len(own), -1) for d in data]
        x = [np.concatenate([piece[i] for piece in pieces]) for i in range(len(own))]
        found = list(_pairs_of(x, here, here if b is None else list(range(len(a), len(own))), b is None))
        i, j, n, pearson, spearman = zip(*found, strict=True) if found else ([],) * 5
        ends = [sorted((own[k], own[m])) if right is None else (own[k], own[m]) for k, m in zip(i, j, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.string()), pa.array(n, pa.int64()), pa.array(pearson, pa.float64()), pa.array(spearman, pa.float64())], ["l", "r", "n", "pearson", "spearman"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, data = None, []
        for batch in batches:
            for t, d in zip(batch.column("task").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if t != task and data:
                    yield solved(task, data)
                    data = []
                task = t
                data.append(d)
        if data:
            yield solved(task, data)

    sent = wide.select(*[F.col(f"`{n}`").cast("double") for n in names]).mapInArrow(packed, "task int, data binary")
    return sent.repartition(len(tasks), "task").sortWithinPartitions("task").mapInArrow(fold, "l string, r string, n long, pearson double, spearman double")
