"""SimHash near-dedup by generalised pigeonhole.

A document's fingerprint has BITS bits: each distinct word votes on every bit with a bit of its own hash, and the
majority decides. Two documents are near-copies if their fingerprints differ in at most `radius` bits; groups are the
connected components of that relation, and one document of each group, that with the smallest id, is kept.

Finding the pairs: the correlations of all bits are counted over all fingerprints, and correlated bits are grouped into
PARTS partitions of equal width. Fingerprints at most `radius` apart are, for any thresholds t_1 ... t_m with
sum(t_i + 1) = radius + 1, at most t_i apart in some partition i. How many pairs lie within t in partition i follows
exactly from how often each value of the partition occurs, and a dynamic programme gives the partitions the thresholds
(-1: not probed) that make the sum of these candidates least. Probing: within t_i bits of a partition, one of its
t_i + 1 parts is equal, so fingerprints are exchanged by (partition, part, value of part), values that more than GROUP
share in blocks of which every two meet; a bucket probes the values
within reach of each value. A pair that is equal in several parts of a partition is left to the first one's bucket. By the
same principle one half of the partitions holds the pair to the sum of its own t_i + 1, less 1, so candidates are
compared on that half, and the few that remain on all bits; values with many candidates are compared in blocks. No pair is
missed and none is dropped, whatever the size of a bucket. Equal fingerprints are put together first, and a bucket passes on a spanning forest of the pairs it
verified, as only the components are asked for.

Result of `groups`: (doc_id, group_id, kept), the documents that are in a group with others. Edge cases: documents
without words (null, empty, white space) have no fingerprint and are in no group; ties of a vote count as 0; rows with
a null id are left out; of rows that repeat an id one counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, mix, packed_rows, pieces, texts_of, unpacked, words_of
from .components import components, forest
from .repeats import unique_ids

BITS, PARTS, WIDTH = 128, 8, 16
RADIUS = 24
#: Fingerprints that are probed in one group; where more share a part's value, they meet in blocks of half as many.
GROUP = 1 << 21
#: Pairs that are compared at a time, and pairs of one value with those in its reach from which they are compared in blocks.
BLOCK, MANY = 1 << 16, 1 << 12
#: Thresholds considered for one partition.
_MOST = 6

_LANES = np.array([sum(1 << 16 * i for i in range(4) if v >> i & 1) for v in range(16)], np.uint64)


def fingerprints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 2 words of 64 bits, number of distinct words of each row)."""
    rows = len(texts)
    words, starts = words_of(texts)
    out, distinct = np.zeros((rows, 2), np.uint64), np.zeros(rows, np.int64)
    if not len(words):
        return out, distinct
    import xxhash

    coded = words.dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(starts))
    key = np.sort(owner * np.int64(len(names)) + coded.indices.to_numpy())
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner, code = key // len(names), key % len(names)
    distinct = np.bincount(owner, minlength=rows)
    # four counters of 16 bits share a word: a segment has at most 65,535 words, a longer document several segments
    begin = np.concatenate([[0], np.cumsum(distinct)])
    nth = np.arange(len(owner)) - begin[owner]
    segment = np.flatnonzero(nth % 65_535 == 0)
    holder = owner[segment]
    more = len(np.unique(holder)) < len(holder)
    for half in range(2):
        h = mix(names + np.uint64(half * 0x9E3779B9 + 1))
        for nibble in range(16):
            table = _LANES[(h >> np.uint64(4 * nibble) & np.uint64(15)).astype(np.int64)]
            sums = np.add.reduceat(table[code], segment)
            for lane in range(4):
                votes = (sums >> np.uint64(16 * lane) & np.uint64(0xFFFF)).astype(np.int64)
                if more:
                    votes = np.bincount(holder, weights=votes, minlength=rows).astype(np.int64)
                    won = votes * 2 > distinct
                else:
                    won = np.zeros(rows, bool)
                    won[holder] = votes * 2 > distinct[holder]
                out[:, half] |= won.astype(np.uint64) << np.uint64(4 * nibble + lane)
    return out, distinct


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            prints, distinct = fingerprints_of(texts_of(part, "text"))
            some = distinct > 0
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(some)), pa.array(prints[some, 0].view(np.int64)), pa.array(prints[some, 1].view(np.int64))], names=["doc_id", "lo", "hi"])


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A row of BITS zeros and ones for each fingerprint."""
    raw = np.column_stack([lo, hi]).astype(np.int64).view(np.uint8).reshape(len(lo), 16)
    return np.unpackbits(raw, axis=1, bitorder="little")


def _correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS), np.int64), 0
    for b in batches:
        for at in range(0, b.num_rows, 1 << 14):
            x = _bits(b.column("lo").to_numpy()[at : at + (1 << 14)], b.column("hi").to_numpy()[at : at + (1 << 14)]).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
    if n:
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(BITS * BITS, n))], names=["i", "j", "both", "n"])


def partition(both: np.ndarray, n: int) -> np.ndarray:
    """The bits in a new order: each WIDTH of them, a partition, correlate as strongly as a greedy choice finds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, order = set(range(BITS)), []
    while left:
        rest = sorted(left)
        first = rest[int(strength[np.ix_(rest, rest)].max(1).argmax())]
        group = [first]
        left.remove(first)
        while len(group) < WIDTH:
            rest = sorted(left)
            group.append(rest[int(strength[np.ix_(rest, group)].sum(1).argmax())])
            left.remove(group[-1])
        order += group
    return np.array(order)


@lru_cache(None)
def masks(bits: tuple[int, ...], reach: int) -> np.ndarray:
    """All values of at most `reach` of these bits."""
    return np.array([sum(1 << b for b in c) for k in range(min(reach, len(bits)) + 1) for c in combinations(bits, k)], np.int64)


def estimate(counts: np.ndarray) -> list[float]:
    """Pairs within 0, 1, ... _MOST bits of each other in a partition whose value v occurs counts[v] times."""
    values = np.flatnonzero(counts)
    # the number of pairs at each distance, by a Walsh-Hadamard transform: exact, and as fast for every reach
    spectrum = counts.astype(np.float64).copy()
    step = 1
    while step < len(spectrum):
        x = spectrum.reshape(-1, 2, step)
        spectrum = np.concatenate([x[:, :1] + x[:, 1:], x[:, :1] - x[:, 1:]], axis=1).ravel()
        step *= 2
    apart = spectrum**2
    step = 1
    while step < len(apart):
        x = apart.reshape(-1, 2, step)
        apart = np.concatenate([x[:, :1] + x[:, 1:], x[:, :1] - x[:, 1:]], axis=1).ravel()
        step *= 2
    apart /= len(apart)
    by = np.bincount(np.bitwise_count(np.arange(len(apart))), weights=apart, minlength=_MOST + 1)
    return np.cumsum(by)[: _MOST + 1].tolist() if len(values) else [0.0] * (_MOST + 1)


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds with sum(t + 1) = radius + 1 (t from -1) whose candidates are fewest, by dynamic programming."""
    need = radius + 1
    best = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, _MOST + 1):
                k = min(need, total + t + 1)
                new = cost + (c[t] if t >= 0 else 0.0)
                if k not in after or new < after[k][0]:
                    after[k] = (new, chosen + [t])
        best = after
    if need not in best:
        raise ValueError(f"radius {radius} is beyond {len(costs)} partitions")
    return best[need][1]


def subparts(t: int) -> list[tuple[int, ...]]:
    """The t + 1 parts of a partition's bits, of which one is equal within t bits."""
    return [tuple(int(b) for b in x) for x in np.array_split(np.arange(WIDTH), t + 1)]


def arranged(lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The fingerprints with their bits in this order, two words each: their distances are the same, and partition g is the
    16 bits from 16 * g."""
    return np.ascontiguousarray(np.packbits(_bits(lo, hi)[:, order], axis=1, bitorder="little")).view("<u8")


def _values(prints: np.ndarray) -> np.ndarray:
    """The value of each partition of each arranged fingerprint."""
    return prints.view("<u2").astype(np.int64)


class Unit:
    """One exchange of the fingerprints: by the value of a part of a partition's bits, and where more than `most` have the
    same value, in blocks by a hash of which every two meet."""

    def __init__(self, g: int, part: tuple[int, ...], threshold: int, counts: np.ndarray, most: int):
        self.g, self.part, self.threshold = g, part, threshold
        values = np.arange(1 << WIDTH)
        for bits in range(min(6, len(part)), len(part) + 1):
            self.bits = part[:bits]
            sizes = np.bincount(self.keys(values), weights=counts, minlength=1 << bits)
            if sizes.max() <= most:
                break
        self.blocks = np.where(sizes > most, -(-2 * sizes // most), 1).astype(np.int64)

    def keys(self, values: np.ndarray) -> np.ndarray:
        key = np.zeros(len(values), np.int64)
        for k, bit in enumerate(self.bits):
            key |= (values >> bit & 1) << k
        return key


def _units(thresholds: list[int], counts: np.ndarray, most: int) -> list[Unit]:
    return [Unit(g, part, t, counts[g], most) for g, t in enumerate(thresholds) if t >= 0 for part in subparts(t)]


def _send(order: np.ndarray, units: list[Unit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, lo, hi = (b.column(c).to_numpy() for c in ("id", "lo", "hi"))
            prints = arranged(lo, hi, order)
            values, points = _values(prints), np.column_stack([ids, prints.view(np.int64)])
            for u, unit in enumerate(units):
                v = values[:, unit.g]
                key, at = unit.keys(v), np.arange(len(v))
                i = j = np.zeros(len(v), np.int64)
                blocks = unit.blocks[key]
                if blocks.max() > 1:
                    own = (mix(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    at = np.repeat(at, blocks)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    i, j = np.minimum(own[at], other), np.maximum(own[at], other)
                    key = key[at]
                by = np.lexsort((j, i, key))
                cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key[by]) != 0) | (np.diff(i[by]) != 0) | (np.diff(j[by]) != 0), [True]]))
                rows = []
                for a, z in zip(cuts[:-1], cuts[1:]):
                    k, first = at[by[a:z]], by[a]
                    rows.append((u, int(key[first]), int(i[first]), int(j[first]), points[k].tobytes()))
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int32()) for c in range(4)), pa.array([r[4] for r in rows], pa.binary())], names=["unit", "key", "i", "j", "points"])

    return run


class Ties:
    """Components of the rows of one bucket, as pairs of them come; label: the smallest row known of each row's component."""

    def __init__(self, rows: int):
        self.label, self.waiting, self.pairs, self.joins = np.arange(rows), [], 0, 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.pairs += len(a)
        if self.pairs >= max(1 << 16, len(self.label) // 8):
            self.join()

    def join(self) -> None:
        if self.waiting:
            self.label = forest(len(self.label), *map(np.concatenate, zip(*self.waiting)), self.label)
            self.waiting, self.pairs, self.joins = [], 0, self.joins + 1


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of each span, one span after the other."""
    return np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)


def tie_near(prints: np.ndarray, value: np.ndarray, reach: np.ndarray, half: int, limit: int, radius: int) -> np.ndarray:
    """The label of each row, of the pairs whose values differ by one of the masks, whose words `half` are within limit and
    whose fingerprints are within radius. Values of many pairs are compared in blocks, the rows of the value with those of
    all larger ones in reach; of the others, pair after pair is looked up."""
    by = np.argsort(value, kind="stable")
    v, near, rest = value[by], np.ascontiguousarray(prints[by, half]), np.ascontiguousarray(prints[by, 1 - half])
    count = np.bincount(v, minlength=1 << WIDTH)
    begin = np.concatenate([[0], np.cumsum(count)])
    ties = Ties(len(v))

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        ok = np.bitwise_count(near[x] ^ near[y]) + np.bitwise_count(rest[x] ^ rest[y]) <= radius
        if ok.any():
            ties.add(by[x[ok]], by[y[ok]])

    def block(rows: np.ndarray, cols: np.ndarray) -> None:
        """Every row with every column; once all rows are in one component, only with columns that aren't in it."""
        a, joins = 0, -1
        while a < len(rows):
            if joins != ties.joins:
                joins, own = ties.joins, ties.label[by[rows[a:]]]
                if (own == own[0]).all():
                    cols = cols[ties.label[by[cols]] != own[0]]
            x = rows[a : a + max(1, BLOCK // max(1, len(cols)))]
            for c in range(0, len(cols), BLOCK):
                y = cols[c : c + BLOCK]
                at = np.flatnonzero(np.bitwise_count(near[x][:, None] ^ near[y]) <= limit)
                if len(at):
                    verify(x[at // len(y)], y[at % len(y)])
            a += len(x)

    there = np.flatnonzero(count)
    for at in range(0, len(there), step := max(1, BLOCK // len(reach))):
        own = there[at : at + step]
        other = own[:, None] ^ reach
        n = np.where(other >= own[:, None], count[other], 0)
        work = count[own] * n.sum(1)
        for k in np.flatnonzero(work >= MANY):
            block(np.arange(begin[own[k]], begin[own[k] + 1]), _spans(begin[other[k]], n[k]))
        few = np.flatnonzero((work > 0) & (work < MANY))
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(work[few]) // BLOCK)) + 1):
            k, j = np.nonzero(n[part])
            k = part[k]
            rows = count[own[k]]
            x = _spans(begin[own[k]], rows)
            same = np.repeat(reach[j] == 0, rows)  # of its own value, a row meets those after it
            first = np.where(same, x + 1, np.repeat(begin[other[k, j]], rows))
            length = np.where(same, np.repeat(begin[own[k] + 1], rows) - x - 1, np.repeat(n[k, j], rows))
            x, y = np.repeat(x, length), _spans(first, length)
            close = np.flatnonzero(np.bitwise_count(near[x] ^ near[y]) <= limit)
            verify(x[close], y[close])
    ties.join()
    return ties.label


def reach_of(unit: Unit) -> np.ndarray:
    """By what the values of a pair may differ that this unit looks for: a pair that is equal in an earlier part of the
    partition too is left to that part's unit."""
    every = masks(tuple(b for b in range(WIDTH) if b not in unit.part), unit.threshold)
    for part in subparts(unit.threshold):
        if part == unit.part:
            return every
        every = every[(every & sum(1 << b for b in part)) != 0]


def _probe(units: list[Unit], thresholds: list[int], radius: int):
    # as the sum of t + 1 is radius + 1, the half of a pair within reach that has the partition may be held to its own sum
    limits = [sum(t + 1 for t in half) - 1 for half in (thresholds[: PARTS // 2], thresholds[PARTS // 2 :])]

    def take(t: pa.Table) -> pa.Table:
        points = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in t.column("points")])
        points = points[np.argsort(points[:, 0], kind="stable")]  # a component is named after its smallest id
        unit = units[t.column("unit")[0].as_py()]
        prints = np.ascontiguousarray(points[:, 1:]).view(np.uint64)
        half = unit.g // (PARTS // 2)
        label = tie_near(prints, _values(prints)[:, unit.g], reach_of(unit), half, limits[half], radius)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": points[tied, 0], "b": points[label[tied], 0]})

    return take


def groups(docs: DataFrame, radius: int = RADIUS, tables: Written | None = None, most: int = GROUP) -> DataFrame:
    tables = tables or Written(docs.sparkSession)
    prints = tables.put("prints", unique_ids(docs).mapInArrow(_prints, "doc_id long, lo long, hi long"))
    points = tables.put("points", prints.groupBy("lo", "hi").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    # BITS x BITS counts and PARTS x 2**WIDTH counts, whatever the size of the corpus
    found = points.mapInArrow(_correlate, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    both[found["i"], found["j"]] = found["both"]
    order = partition(both, int(found["n"].max()) if len(found) else 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            values = _values(arranged(b.column("lo").to_numpy(), b.column("hi").to_numpy(), order))
            for g in range(PARTS):
                total[g] += np.bincount(values[:, g], minlength=1 << WIDTH)
        g, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((g << WIDTH | v).astype(np.int64)), pa.array(total[g, v])], names=["at", "n"])

    seen = points.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(PARTS << WIDTH, np.int64)
    counts[seen["at"].to_numpy()] = seen["n"].to_numpy()
    thresholds = allocate([estimate(c) for c in counts.reshape(PARTS, -1)], radius)
    units = _units(thresholds, counts.reshape(PARTS, -1), most)
    sent = points.select("id", "lo", "hi").mapInArrow(_send(order, units), "unit int, key int, i int, j int, points binary")
    edges = sent.groupBy("unit", "key", "i", "j").applyInArrow(_probe(units, thresholds, radius), "a long, b long")
    roots = components(edges, tables)
    named = points.join(roots, "id", "left").where("copies > 1 or root is not null").select("lo", "hi", F.coalesce("root", "id").alias("group_id"))
    return prints.join(named, ["lo", "hi"]).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group; columns stay. Rows with a null id stay, as do those without words."""
    tables = Written(docs.sparkSession)
    gone = tables.put("gone", groups(docs, radius, tables).where("not kept").select("doc_id"))
    tables.keep("gone")
    # Spark broadcasts the ids if the table written is small enough for it, else it shuffles
    one = unique_ids(packed_rows(docs)).join(gone, "doc_id", "left_anti")
    return unpacked(one, docs.columns).unionByName(docs.where("doc_id is null"))
