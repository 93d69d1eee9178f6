"""Packing: minimum bin slack over the multiset of remaining lengths.

A document of n words is cut into pieces of at most `capacity` words (all but its last piece are full), and the pieces
are packed into windows of `capacity`. All that the planning needs is how many pieces there are of each length, a table
of at most `capacity` rows whatever the size of the corpus. The planner takes the longest length left, and a subset-sum
dynamic programme over the bits of one integer (bit s: the sum s can be made from the lengths left, each at most as
often as it is left) finds the multiset that fills the window closest to its capacity; walking back through the
programme gives how often each length is used. That filling is used for as many windows as the counts allow at once, so
the plan has about as many entries as there are lengths. Pieces then take the places of their length in order of doc_id
and piece: their ranks come from one range-partitioned pass and the counts of each partition, with no window over all
rows of a length.

Result: (window_id, doc_id, piece, start, length, at): the words [start, start + length) of the document stand at word
`at` of the window. Edge cases: null, empty and white-space texts have no words and no row; rows with a null doc_id have
no row; repeated rows are packed as often as they occur; equal ranks only exist between equal rows, so ties don't
change the result; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

CAPACITY = 2048


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The filling of one window: the longest length left, and with it the lengths that leave the least slack."""
    first = max(left)
    room = capacity - first
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        many = min(left[length] - (length == first), room // length)
        part = 1
        while many > 0 and not bits >> room & 1:
            part = min(part, many)
            steps.append((bits, length, part))
            bits |= bits << (length * part) & mask
            many -= part
            part *= 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    used = {first: 1}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, {length: how often in each}) until every piece has its place."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        used = fill(left, capacity)
        times = min(left[k] // v for k, v in used.items())
        out.append((times, used))
        for k, v in used.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def _places(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """The plan as arrays, by length and then by the rank at which an entry begins."""
    taken: dict[int, int] = {}
    rows, window = [], 0
    for times, used in plan(counts, capacity):
        at = 0
        for length in sorted(used, reverse=True):
            begin = taken.get(length, 0)
            rows.append((length, begin, used[length], window, at))
            taken[length] = begin + used[length] * times
            at += length * used[length]
        window += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "begin", "each", "window", "at"), table.T))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    spark = docs.sparkSession
    tables = Written(spark)
    words = F.expr(r"regexp_count(coalesce(text, ''), '\\S+')")
    lengths = tables.put("lengths", docs.where("doc_id is not null").select("doc_id", words.alias("n")).where("n > 0"))
    cut = F.expr(f"transform(sequence(0, int((n - 1) div {capacity})), k -> struct(k AS piece, int(least({capacity}, n - k * {capacity})) AS length))")
    rows = lengths.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.piece", "c.length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks within the partition and length: rows come sorted."""
        last, seen = -1, 0
        for b in batches:
            length = b.column("length").to_numpy()
            if not len(length):
                continue
            new = np.concatenate([[length[0] != last], length[1:] != length[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(length)), 0))
            rank = np.arange(len(length)) - begin
            if not new[0]:
                rank[: np.argmax(new) if new.any() else len(new)] += seen
            last, seen = length[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("length"), b.column("part"), pa.array(rank, pa.int64())], names=["doc_id", "piece", "length", "part", "rank"])

    ranged = rows.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece").withColumn("part", F.spark_partition_id())
    ranked = tables.put("ranked", ranged.mapInArrow(number, "doc_id long, piece int, length int, part int, rank long"))
    # at most one row for each length and each partition: bounded by capacity + partitions, not by the corpus
    found = ranked.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])
    before, base = {}, {}
    for length, part, n in found.itertuples(index=False):
        base[int(length), int(part)] = before.get(int(length), 0)
        before[int(length)] = before.get(int(length), 0) + int(n)
    places = _places(before, capacity)
    tables.drop("lengths")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_, begins = places["length"], places["begin"]
        first = {int(k): (int(lo), int(hi)) for k, lo, hi in zip(*(lambda u: (u, np.searchsorted(lengths_, u), np.searchsorted(lengths_, u, "right")))(np.unique(lengths_)))}
        for b in batches:
            length, part, rank = (b.column(c).to_numpy() for c in ("length", "part", "rank"))
            row = np.zeros(len(length), np.int64)
            rank = rank.copy()
            if len(length):
                key = length.astype(np.int64) << 32 | part
                for k in np.unique(key):
                    mine = key == k
                    rank[mine] += base[int(k >> 32), int(k & 0xFFFFFFFF)]
                for k in np.unique(length):
                    mine = length == k
                    lo, hi = first[int(k)]
                    row[mine] = lo + np.searchsorted(begins[lo:hi], rank[mine], "right") - 1
            over, each = rank - begins[row] if len(rank) else rank, places["each"][row] if len(rank) else rank
            window = places["window"][row] + over // each if len(rank) else rank
            at = places["at"][row] + over % each * length if len(rank) else rank
            start = b.column("piece").to_numpy().astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.int64()), b.column("doc_id"), b.column("piece"), pa.array(start, pa.int64()), b.column("length"), pa.array(at, pa.int64())], names=["window_id", "doc_id", "piece", "start", "length", "at"])

    return ranked.mapInArrow(assign, "window_id long, doc_id long, piece int, start long, length int, at long")
