"""Suffix-array dedup: repeated passages by sorting suffixes.

Every window of `least` words has a suffix that stands for it: the one that begins at the smallest (by hash, then the
leftmost) of the GRAM-word runs inside the window. Equal windows choose alike, so a window occurs twice only if its
suffix's leading GRAM words do too; suffixes whose leading words are unique in the corpus can't take part and are
dropped after one exchange of their hashes. The suffixes left, with as many words on both sides as their windows
reach, are range-partitioned by their leading words with splitters taken from a sample of them; each bucket is sorted
by multikey quicksort, three-way partitioning by the word at a depth, and neighbours are compared for their common
prefixes. As splitters are leading words, suffixes that agree in these are never parted, so no window reaches over the
border between two ranges. Only hot leads, those of more than HOT suffixes, are cut further, into parts by a hash of the
document; windows that the parts leave open (each once a part) are then compared across these borders by their names,
64-bit hashes of the whole window. Windows then repeat where neighbours share enough words to the right and the same words to the left.

Words are compared by 32-bit hashes, `least` of them a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, mix, pieces
from .repeats import LEAST, PART, Words, cut, exchange, grouped, is_shared, shared_keys, spans, text_bytes, unique_ids, unpack

GRAM = 8
#: One in so many of the suffixes is used to place the splitters and to find hot leading words (it changes no result).
SAMPLE = 16
#: Suffixes with equal leading words from which these are hot, and bytes of suffixes in a range.
HOT, SORTED = 100_000, 32 << 20


def anchors(w: Words, least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the suffixes that stand for windows, and the first and last window of each (indices into the
    part's words). Windows of one document that share a suffix follow each other."""
    many = np.maximum(w.n - least + 1, 0)
    if not many.sum():
        return (np.zeros(0, np.int64),) * 3
    size = len(w.h)
    at = np.arange(size - gram + 1)
    key = w.runs(at, at + gram)
    # the high bits order runs by hash, the low ones equal runs by place
    bits = np.uint64(max(1, int(size).bit_length()))
    low = (key >> bits << bits) | at.astype(np.uint64)
    width = least - gram + 1
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    doc = np.repeat(np.arange(len(many)), many)
    window = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + w.starts[:-1][doc]
    place = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(place)]]) - 1
    return place[new], window[new], window[last]


def _short(h: np.ndarray) -> np.ndarray:
    """32-bit names of words; 0 is kept for what lies beyond a document."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    return np.maximum(x, np.uint32(1))


def multikey(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of words: multikey quicksort."""
    out = np.arange(len(words))
    todo = [(0, len(out), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        while hi - lo > 1 and depth < words.shape[1]:
            part = out[lo:hi]
            if hi - lo <= 32:
                tail = words[part, depth:].astype(">u4")
                names = [r.tobytes() for r in tail]
                out[lo:hi] = part[sorted(range(len(names)), key=names.__getitem__)]
                break
            col = words[part, depth]
            a, b, c = col[0], col[len(col) // 2], col[-1]
            pivot = max(min(a, b), min(max(a, b), c))
            less, more = col < pivot, col > pivot
            equal = ~(less | more)
            if equal.all():
                # what all rows have in common is passed at once
                differs = (words[part, depth:] != words[part[0], depth:]).any(0)
                depth += int(differs.argmax()) if differs.any() else words.shape[1]
                continue
            i, j = lo + int(less.sum()), hi - int(more.sum())
            out[lo:hi] = np.concatenate([part[less], part[equal], part[more]])
            todo += [(lo, i, depth), (j, hi, depth)]
            lo, hi, depth = i, j, depth + 1
    return out


def _keys(least: int):
    def make(part: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
        w = Words(part)
        place, _, _ = anchors(w, least)
        place = np.unique(place)
        if len(place):
            names = _short(w.h)
            lead = names[place].astype(np.uint64) << np.uint64(32) | names[place + 1]
            yield from shared_keys(w, w.runs(place, place + GRAM), place, lead, buckets)

    return make


def _take_keys(t: pa.Table) -> pa.Table:
    keys, ids, place, lead = unpack(t, np.uint64)
    hit = is_shared(keys)
    ids, place, lead = ids[hit], place[hit], lead[hit]
    with np.errstate(over="ignore"):
        some = mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)) % np.uint64(SAMPLE) == 0
    places, leads = grouped(ids, place.astype(np.int32), names=("places",)), grouped(ids[some], lead[some].view(np.int64), names=("leads",))
    none = lambda n, kind: pa.nulls(n, pa.list_(kind))
    return pa.Table.from_batches([
        pa.RecordBatch.from_arrays([*places.columns, none(places.num_rows, pa.int64())], names=["doc_id", "places", "leads"]),
        pa.RecordBatch.from_arrays([leads.column(0), none(leads.num_rows, pa.int32()), leads.column(1)], names=["doc_id", "places", "leads"]),
    ])


def _suffixes(least: int, splitters: np.ndarray, hot: np.ndarray, parts: np.ndarray):
    """Rows of a part for each bucket: the suffixes' words to the right and left, and which windows they stand for. A
    bucket is (range of leads, 0), or for a hot lead (its number after the ranges, one of its parts from 1)."""
    right, left = least, least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PART // 4):
                w = Words(part)
                place, first, last = anchors(w, least)
                lists = part.column("places")
                begin = lists.offsets[0].as_py()
                flat = lists.values.to_numpy()[begin : lists.offsets[-1].as_py()].astype(np.int64)
                wanted = np.zeros(len(w.h) + 1, bool)
                wanted[flat + np.repeat(w.starts[:-1], np.diff(lists.offsets.to_numpy()))] = True
                mine = wanted[place]
                place, first, last = place[mine], first[mine], last[mine]
                if not len(place):
                    continue
                names = np.concatenate([np.zeros(left, np.uint32), _short(w.h), np.zeros(right, np.uint32)])
                doc = w.owner()[place]
                stop, zero = w.starts[doc + 1][:, None], w.starts[doc][:, None]
                i = place[:, None] + np.arange(right)
                j = place[:, None] - 1 - np.arange(left)
                words = np.concatenate([np.where(i < stop, names[i + left], 0), np.where(j >= zero, names[j + left], 0)], axis=1).astype(np.uint32)
                lead = words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1]
                bucket, share = np.searchsorted(splitters, lead, "right"), np.zeros(len(lead), np.int64)
                if len(hot):
                    which = np.minimum(np.searchsorted(hot, lead), len(hot) - 1)
                    is_hot = hot[which] == lead
                    bucket = np.where(is_hot, len(splitters) + 1 + which, bucket)
                    share = np.where(is_hot, 1 + (mix(w.ids[doc].view(np.uint64)) % parts[which].astype(np.uint64)).astype(np.int64), 0)
                order = np.lexsort((share, bucket))
                at = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(share[order]) != 0), [True]]))
                rows = []
                for a, b in zip(at[:-1], at[1:]):
                    k = order[a:b]
                    who = np.column_stack([w.ids[doc[k]], place[k] - w.starts[doc[k]], place[k] - last[k], place[k] - first[k]])
                    rows.append((int(bucket[k[0]]), int(share[k[0]]), who.astype(np.int64).tobytes(), words[k].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "share", "who", "words"])

    return run


def _sort(least: int):
    """Marks of the windows that repeat in a bucket: (doc_id, marks). In a part of a hot lead the first of equal windows
    may not be the first of all, and one that is alone may not be alone: these come with the window's name and how many
    there are, (doc_id, marks, keys, counts), for the comparison across the borders between the parts."""

    def take(t: pa.Table) -> pa.Table:
        border = t.column("share")[0].as_py() > 0
        who = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in t.column("who")])
        words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).reshape(-1, 2 * least - GRAM) for x in t.column("words")])
        order = multikey(words[:, :least])
        who, words = who[order], words[order]
        apart = words[1:, :least] != words[:-1, :least]
        common = np.where(apart.any(1), apart.argmax(1), least)
        left = words[:, least:]
        ids, place, low, high = who.T
        out: list[tuple] = []
        with np.errstate(over="ignore"):
            sums = np.zeros(len(who), np.uint64)
            if border:
                # a name of the first least - back words to the right, from back = 0 on, read from their sums
                weight = np.multiply.accumulate(np.full(least, np.uint64(0xA0761D6478BD642F)))
                right = np.cumsum(mix(words[:, :least]) * weight, axis=1, dtype=np.uint64)
            del words, apart
            for back in range(int(high.max()) + 1):
                if back:
                    sums = mix(sums * np.uint64(0x9E3779B97F4A7C15) + left[:, back - 1])
                run = np.concatenate([[0], np.cumsum(common < least - back)])
                live = np.flatnonzero((low <= back) & (back <= high))
                if len(live) < 1 + (not border):
                    continue
                key = mix(sums[live] + run[live].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                by = np.lexsort((place[live], ids[live], key))
                same = key[by][1:] == key[by][:-1]
                copy = np.concatenate([[False], same])
                hit = copy if border else copy | np.concatenate([same, [False]])
                found = live[by[hit]]
                out.append((ids[found], (place[found] - back) * 2 + copy[hit], np.zeros(len(found), np.uint64), np.zeros(len(found), np.int64)))
                if border:
                    head = np.flatnonzero(~copy)
                    first = live[by[head]]
                    name = mix(mix(right[first, least - back - 1] + sums[first] * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(back + 1))
                    out.append((ids[first], (place[first] - back) * 2, np.maximum(name, np.uint64(1)), np.diff(head, append=len(by))))
        ids, marks, keys, counts = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        sure = keys == 0
        done, open_ = grouped(ids[sure], marks[sure].astype(np.int32), names=("marks",)), grouped(ids[~sure], marks[~sure].astype(np.int32), keys[~sure].view(np.int64), counts[~sure].astype(np.int32), names=("marks", "keys", "counts"))
        none = [pa.nulls(done.num_rows, pa.list_(k)) for k in (pa.int64(), pa.int32())]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*done.columns, *none], names=open_.schema.names), open_])

    return take


def _across(found: DataFrame) -> DataFrame:
    """The marks of windows that parts of hot leads left open: equal ones stand under one name, once for each part."""
    each = Window.partitionBy("key")
    rows = found.where("keys is not null").select("doc_id", F.explode(F.arrays_zip("marks", "keys", "counts")).alias("x")).select("doc_id", F.col("x.marks").alias("mark"), F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    rows = rows.select("doc_id", "mark", F.sum("n").over(each).alias("all"), F.min(F.struct("doc_id", "mark")).over(each).alias("first")).where("all > 1")
    return rows.select("doc_id", F.array(F.col("mark") + F.when(F.struct("doc_id", "mark") == F.col("first"), 0).otherwise(1)).alias("marks"))


def find(docs: DataFrame, least: int = LEAST, hot_rows: int = HOT) -> DataFrame:
    """(doc_id, start, end, copy) as described in repeats."""
    if least < 2 * GRAM:
        raise ValueError(f"least must be at least {2 * GRAM}")
    tables = Written(docs.sparkSession)
    docs = unique_ids(docs)
    shared = tables.put("shared", exchange(docs, text_bytes(docs), _keys(least), _take_keys, "doc_id long, places array<int>, leads array<long>"))
    # unsigned order is kept by flipping the top bit
    flip = F.expr("x ^ (-9223372036854775807L - 1L)")
    leads = shared.select(F.explode("leads").alias("x")).select(flip.alias("x"))
    sampled = leads.count()
    # leads of more rows than a task should sort: one in hot_rows of all at most
    hot = leads.groupBy("x").count().where(F.col("count") * SAMPLE > hot_rows).toArrow()
    order = np.argsort(hot["x"].to_numpy())
    parts = -(-hot["count"].to_numpy()[order] * SAMPLE // hot_rows)
    hot = hot["x"].to_numpy()[order].view(np.uint64) ^ np.uint64(1 << 63)
    # splitters: as many as the sampled rows ask for
    buckets = max(1, -(-sampled * SAMPLE * (8 * least) // SORTED))
    shares = [i / buckets for i in range(1, buckets)]
    got = leads.agg(F.percentile_approx("x", shares, 100 * buckets)).first()[0] if shares and sampled else None
    splitters = np.unique(np.array(got or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    places = shared.where("places is not null").groupBy(F.col("doc_id").alias("_wl_id")).agg(F.flatten(F.collect_list("places")).alias("places"))
    around = docs.join(places.hint("shuffle_hash"), docs["doc_id"] == places["_wl_id"]).select("doc_id", "text", "places")
    rows = around.mapInArrow(_suffixes(least, splitters, hot, parts), "bucket int, share int, who binary, words binary")
    found = rows.groupBy("bucket", "share").applyInArrow(_sort(least), "doc_id long, marks array<int>, keys array<long>, counts array<int>")
    if len(hot):
        found = tables.put("sorted", found)
        found = found.where("keys is null").select("doc_id", "marks").union(_across(found))
    return spans(found.select("doc_id", "marks"), least)


def drop_copies(docs: DataFrame, least: int = LEAST, length: str | None = None) -> DataFrame:
    """docs with the copied words cut out of their texts; the columns stay. length: see repeats.cut."""
    return cut(docs, find(docs, least), length)
