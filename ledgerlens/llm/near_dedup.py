"""Operator 5, MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. Every whole text gives its set of distinct 5-word shingles as 64-bit hashes.  The top 7 or 8 bits of a hash are
   its bin, the least hash of a bin its value; an empty bin copies the first filled bin in a fixed random order of its
   own (optimal densification).  Bands of 5 bins give the bucket keys: 24 of 128 at a likeness of 0.85, 35 of 256 at
   0.8: the fewest with which a pair at that likeness shares no bucket with probability under 1e-6.
2. Texts with equal sets are one node, the smallest doc_id with that set.
3. In each bucket one centre, the node that shares most bucket places with others, is compared with every other node: a
   star, not all pairs.  Pairs are confirmed on full sets; confirmed links merge components.
4. Two nodes x and y of a star that are linked, but not through the centre c, share some shingle outside of c: a link
   needs |x & y| >= 0.85 max(|x|, |y|), and what lies in c is at most |x & c|.  So x is dealt to small buckets of its
   0.15 |x| + 1 first shingles outside of c (a prefix filter), and, where c holds enough of both for a link inside of c
   alone, to one for each size that the smaller one may have.  Small buckets with one component are dropped, equal ones
   kept once.
5. A small bucket is compared in blocks of about BLOCK nodes, two blocks in a task, by counting shared shingles in a
   matrix; blocks of its largest component do not meet each other.  A task returns a spanning forest of its links, never
   pairs.  So every link of every bucket is found.

Full sets move once: a node's set meets the set of its centre in one task, which counts what both hold and writes the
node's set as seen from the centre (a bit for each shingle of the centre, and the hashes of the others) with its small
buckets.  That is all that the later steps read.  The rows of a hot centre are as wide as their sets when they are dealt
by centre, so adaptive execution sees a skewed join and splits it.

Everything is joins and aggregates over tables in the shared folder; nothing is collected but counts.

Defined results: null, empty or wordless texts have an empty set and are linked with nothing; texts of 1 to 4 words
have one shingle, their sequence; rows that share a doc_id count as one document, and a link of one is a link of all;
a null id has a null component and is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.words import U, Words, chunks, constants, mix, shingles

BINS = 128
ROWS = 5
#: A pair at the threshold shares no bucket with a probability under this.
MISS = 1e-6
SHINGLE = 5
#: Nodes on one side of a comparison in a task, about.
BLOCK = 512
#: Bits of the bitmap of dropped ids, 16 MB, and those of one of its rows.
MARKS = 1 << 27
MARK_PART = 1 << 15


def bands_for(similarity: int) -> int:
    """Fewest bands with which a pair at the threshold is missed with probability under MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((similarity / 100) ** ROWS))) if similarity < 100 else 1


def bins_for(bands: int) -> int:
    """Least power of two, BINS or more, with a bin for each row of each band."""
    return max(BINS, 1 << (bands * ROWS - 1).bit_length())


@cache
def bin_orders(bins: int) -> np.ndarray:
    """For each bin all bins in a random order of its own."""
    return mix(np.arange(bins * bins, dtype=np.uint64) + U(7)).reshape(bins, bins).argsort(1)


def one_permutation(distinct: np.ndarray, begin: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified signatures of sets given as one array, each set sorted and not empty, begin[i] to begin[i + 1]."""
    cell = np.repeat(np.arange(len(begin) - 1) * bins, np.diff(begin)) + (distinct >> U(64 - bins.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    order = bin_orders(bins)
    signature, filled = np.zeros((len(begin) - 1) * bins, np.uint64), np.zeros((len(begin) - 1) * bins, bool)
    signature[cell[head]] = distinct[head]
    filled[cell[head]] = True
    empty = np.flatnonzero(~filled)
    for turn in range(bins):
        if not len(empty):
            break
        tried = empty - empty % bins + order[empty % bins, turn]
        found = filled[tried]
        signature[empty[found]] = signature[tried[found]]
        empty = empty[~found]
    return signature.reshape(-1, bins)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One bucket key for each band of each signature."""
    multiply = constants(bands * ROWS, 5).reshape(bands, ROWS)
    rows = signatures[:, : bands * ROWS].reshape(-1, bands, ROWS)
    return mix((rows * multiply).sum(2, dtype=np.uint64) ^ multiply[:, 0])


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    value, begin = shingles(Words(texts), n)
    made = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        s = np.sort(value[a:b])
        made.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
    return made


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sign(bands: int):
    """Set size, fingerprint and bucket keys of each text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, "text"):
                sets = shingle_sets(batch.column("text").slice(a, b - a))
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                begin = np.concatenate([[0], np.cumsum(size[full])])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                keys = band_keys(one_permutation(flat, begin, bins_for(bands)), bands)
                prints = np.zeros((2, len(sets)), np.uint64)
                for k, m in enumerate((U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)) if len(full) else ()):
                    prints[k, full] = np.add.reduceat(mix(flat * m), begin[:-1])
                ends = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(size), *(pa.array(p.view(np.int64)) for p in prints), listed],
                    ["doc_id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(shingle_sets(batch.column("text").slice(a, b - a)))], ["node", "members"])


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) after merging comps along edges (a, b) between comps; a comp is its smallest node.

    Smallest-label propagation with pointer jumping over the comps that have edges.
    """
    both = scratch.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = scratch.put(both.select(F.col("a").alias("c"), F.col("a").alias("low")).distinct(), "label")
    while True:
        near = both.join(label.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("low").alias("near"))
        less = label.join(near, "c", "left").select("c", "low", F.least("low", "near").alias("less"))
        jump = label.select(F.col("c").alias("less"), F.col("low").alias("jump"))
        step = scratch.put(less.join(jump, "less", "left").select("c", F.least("less", "jump").alias("low"), (F.least("less", "jump") < F.col("low")).alias("moved")), "label")
        moved = step.filter("moved").limit(1).count()
        scratch.drop(label)
        label = step.drop("moved")
        label._scratch_path = step._scratch_path
        if not moved:
            break
    merged = scratch.put(nodes.join(label.withColumnRenamed("c", "comp"), "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "comp")
    scratch.drop(both, label, nodes)
    return merged


def link(docs: DataFrame, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, reps, comp): every row's set size and fingerprint; node of each fingerprint; component of each linked node."""
    scratch = Scratch(docs.sparkSession, "dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    banded = scratch.put(texts.mapInArrow(_sign(bands_for(similarity)), "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"), "banded")
    full = banded.filter("n_shingles > 0 and doc_id is not null")
    carried = scratch.put(full.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "carried")
    signed, reps = scratch.put(banded.drop("bands"), "signed"), scratch.put(carried.drop("bands"), "reps")
    scratch.drop(banded)

    placed = carried.select(F.explode("bands").alias("key"), "node")
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    member = scratch.put(placed.join(shared, "key"), "member")
    scratch.drop(carried)
    crowd = member.groupBy("key").agg(F.count("*").alias("n"))
    score = scratch.put(member.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("score")), "score")
    sets = scratch.put(texts.join(score.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "node long, members array<long>"), "sets")

    ranked = member.join(score, "node")
    star = ranked.groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("centre"))
    spoke = scratch.put(member.join(star, "key").filter("node <> centre").select("node", "centre").distinct(), "spoke")
    # One row for each text of a node: rows that share a doc_id may differ.
    # Both joins read the sets dealt by node, so they move once.
    near = spoke.alias("p").join(sets.alias("a"), F.col("p.node") == F.col("a.node")).select("p.node", "p.centre", F.col("a.members").alias("s"))
    both = near.alias("p").join(sets.alias("b"), F.col("p.centre") == F.col("b.node")).select("p.node", "p.centre", "p.s", F.col("b.members").alias("t"))
    seen = scratch.put(both.mapInArrow(_seen(similarity), "pair long, node long, centre long, sure boolean, bits binary, others array<long>, keys array<long>"), "seen")
    comp = scratch.put(score.select("node", F.col("node").alias("comp")), "comp")
    scratch.drop(member, sets, spoke, score)
    comp = components(comp, seen.filter("sure").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), scratch)

    rest = _mixed(seen.select("pair", "node", F.col("centre").alias("key")).join(comp, "node")).select("pair", "comp")
    dealt = seen.select("pair", F.explode("keys").alias("key")).join(rest, "pair")
    small = scratch.put(_mixed(dealt.select("key", "pair", "comp")), "small")
    blocks = _blocks(small)
    grouped = blocks.join(seen.select("pair", "bits", "others"), "pair").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = grouped.select("key", "i", "j", "comp", "bits", "others").mapInArrow(_compare(similarity), "a long, b long")
    comp = components(comp, edges.distinct(), scratch)
    scratch.drop(small, seen)
    return signed, reps, comp


def _seen(similarity: int):
    """Each node's set as seen from its centre, whether both are linked, and the small buckets that the node goes to."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TaskContext.get().partitionId() << 40
        for batch in batches:
            sides = [batch.column(c) for c in ("s", "t")]
            flat = [x.values.to_numpy().view(np.uint64) for x in sides]
            ends = [x.offsets.to_numpy() for x in sides]
            centre = batch.column("centre").to_numpy()
            sure, bits, others, keys = [], [], [], []
            for k in range(batch.num_rows):
                x, c = (f[e[k] : e[k + 1]] for f, e in zip(flat, ends, strict=True))
                inside = _in_sorted(c, x)
                out = x[~_in_sorted(x, c)]
                common = len(x) - len(out)
                sure.append(100 * common >= similarity * (len(x) + len(c) - common))
                bits.append(np.packbits(inside).tobytes())
                others.append(out)
                least = -(-len(x) * similarity // 100)
                prefix = out[: max(0, len(out) - max(least - common, 1) + 1)]
                # Without a shingle outside of c, |x & y| <= |x & c|: that bounds the size of the smaller one from both sides.
                top = min(len(x), common * (100 + similarity) // similarity - len(x))
                sizes = np.arange(least, top + 1, dtype=np.uint64)
                seed = mix(np.array([centre[k]], np.int64).view(np.uint64) ^ mix(c[:1] + U(len(c)) + c.sum(dtype=np.uint64)))
                keys.append(mix(np.concatenate([mix(prefix + U(1)), mix(mix(sizes + U(2)) + U(3))]) ^ seed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair + np.arange(len(sure))), batch.column("node"), batch.column("centre"), pa.array(sure, pa.bool_()), pa.array(bits, pa.binary()), _lists(others), _lists(keys)],
                ["pair", "node", "centre", "sure", "bits", "others", "keys"],
            )
            pair += len(sure)

    return see


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value occurs in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _shared(bits: list[bytes], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one group, which are all seen from the same centre."""
    inside = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)
    shared = np.zeros((len(bits), len(bits)), np.float32)
    width = max(1, (32 << 20) // len(bits))
    for a in range(0, inside.shape[1], width):
        part = inside[:, a : a + width].astype(np.float32)
        shared += part @ part.T
    _, back, count = np.unique(np.concatenate(others), return_inverse=True, return_counts=True)
    kept = count[back] > 1
    row, column = np.repeat(np.arange(len(others)), [len(x) for x in others])[kept], (np.cumsum(count > 1) - 1)[back[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(others), min(width, int(column[-1]) + 1 - a)), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        shared += part @ part.T
    return shared


def _forest(comps: np.ndarray, bits: list[bytes], others: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between components of the sets of one group."""
    if len(bits) < 2 or (comps == comps[0]).all():
        return []
    shared = _shared(bits, others)
    size = np.array([len(x) for x in others]) + np.bitwise_count(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)).sum(1, dtype=np.int64)
    near = 100 * shared >= similarity * (size[:, None] + size[None] - shared)
    near &= comps[:, None] != comps[None]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    made = []
    for p, q in zip(*np.nonzero(np.triu(near)), strict=True):
        a, b = find(int(comps[p])), find(int(comps[q]))
        if a != b:
            root[max(a, b)] = min(a, b)
            made.append((int(comps[p]), int(comps[q])))
    return made


def _compare(similarity: int):
    """Compare the rows of each (key, i, j), which come one after the other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, comps, bits, others, links = None, [], [], [], []
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            own, seen, lists = batch.column("comp").to_numpy(), batch.column("bits"), batch.column("others")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k in range(len(own)):
                if key is None or (at[k] != key).any():
                    links.extend(_forest(np.array(comps), bits, others, similarity))
                    key, comps, bits, others = at[k], [], [], []
                comps.append(int(own[k]))
                bits.append(seen[k].as_py())
                others.append(flat[ends[k] : ends[k + 1]])
        links.extend(_forest(np.array(comps), bits, others, similarity))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return compare


def _blocks(small: DataFrame) -> DataFrame:
    """(key, i, j, pair, comp): the rows of small buckets in the tasks that compare them; equal buckets are kept once.

    The nodes of a bucket's largest component are linked already: their blocks (i under 0) meet the blocks of the other
    nodes, not each other.  The blocks of the others also meet one another.
    """
    part = small.groupBy("key", "comp").agg(F.count("*").alias("m"), *[F.sum(F.xxhash64("pair", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)])
    once = part.groupBy("key").agg(F.sum("m").alias("n"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("m"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    once = once.groupBy("n", "h0", "h1").agg(F.min(F.struct("key", "main", "m")).alias("b")).select("b.key", "b.main", F.ceil(F.col("b.m") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("b.m")) / BLOCK).cast("int").alias("others"))
    main = F.col("comp") == F.col("main")
    rows = small.join(once, "key").withColumn("own", F.pmod(F.xxhash64("pair"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    task = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    meets_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: task(-1 - F.col("own"), j))
    meets_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: task(-1 - i, F.col("own")))
    each_other = F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda j: j != F.col("own")), lambda j: task(F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    return rows.select("key", F.explode(F.when(main, meets_others).otherwise(F.concat(meets_main, each_other))).alias("task"), "pair", "comp").select("key", "task.i", "task.j", "pair", "comp")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp, ...) of the keys that hold two components or more."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    return rows.join(keys, "key")


def near_dedup(docs: DataFrame, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; similarity in hundredths."""
    signed, reps, comp = link(docs, similarity, id_col, text_col)
    named = reps.select("print_a", "print_b", "node").join(comp, "node", "left").select("print_a", "print_b", F.coalesce("comp", "node").alias("comp"))
    # Rows that share a doc_id with a node are that node, whatever their text.
    whole = signed.select("doc_id", "n_shingles", "print_a", "print_b").join(named, ["print_a", "print_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    out = whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, that stay: one document of each group of near-duplicates.

    Rows equal in id and text count once; documents without an id belong to no group and stay.

    A bitmap of fixed size over the hashes of the ids that go or repeat is broadcast: rows whose bit is not set stay
    where they are.  Only the others, whose ids may be among these, meet the list of ids in a join.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    judged = near_dedup(docs, similarity, id_col, text_col).filter("doc_id is not null")
    named = scratch.put(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "named")
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(MARKS))
    marks = named.select(place.alias("at")).groupBy(F.expr(f"at div {MARK_PART}").alias("part")).agg(F.expr(f"bitmap_construct_agg(at % {MARK_PART})").alias("bits"))
    marks = scratch.put(marks, "marks")

    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    at = row.withColumn("at", place).withColumn("in_part", F.expr(f"at div {MARK_PART}"))
    met = at.join(F.broadcast(marks), F.col("in_part") == F.col("part"), "left")
    byte = F.expr(f"cast(conv(hex(substring(bits, cast(at % {MARK_PART} div 8 as int) + 1, 1)), 16, 10) as bigint)")
    marked = F.coalesce(F.col("doc_id").isNotNull() & (F.getbit(byte, (F.col("at") % 8).cast("int")) == 1), F.lit(False))
    listed = met.filter(marked).select("row", "doc_id", "text").join(named, "doc_id", "left").filter(F.coalesce("stays", F.lit(True)))
    stay = met.filter(~marked).select("row").union(listed.filter(F.coalesce("n", F.lit(1)) == 1).select("row"))
    if not named.filter("stays").isEmpty():  # repeated ids: the only rows whose texts must meet
        stay = stay.union(listed.filter("n > 1").dropDuplicates(["doc_id", "text"]).select("row"))
    return stay.select("row.*")
