"""Substring dedup by recompression.

Each document's words are rewritten in rounds. A round first names runs of one symbol, then pairs of neighbours: a
symbol's side (left or right) follows from its name and the round, and a left symbol followed by a right one becomes
one symbol. Names are 64-bit hashes of what they stand for, so all executors name equal runs and pairs alike in every
round and no table of names has to be exchanged; and whether a border between two symbols stays depends on these two
alone. Equal passages are therefore cut alike wherever they stand, but for a few symbols at their ends. After ROUNDS
rounds each symbol, taken with its followers up to SPAN words, is a key; keys are counted over the corpus. A window of
`least` words that occurs twice has such keys inside, so the windows around shared keys are all that can repeat: they
are hashed (64 bits and 31 more that are compared as well), exchanged and compared, and marked as first or copy.

How long a symbol can get is bounded (LONGEST words), which bounds what is lost at the ends of a passage: a round costs
at most two symbols there, in the mean 1.25, so about 8 of 50 words on either side after four rounds, while
a key needs at most SPAN + 2 * LONGEST words. A passage's borders being where they are, a window of just `least`
words could lack a key in principle; the tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix
from .repeats import KNOWN, LEAST, Words, cut, exchange, grouped, near_shared, packed, shared_keys, shared_places, spans, text_bytes, unique_ids, unpack

ROUNDS = 4
LONGEST = 8
SPAN = 10


def recompress(w: Words, rounds: int = ROUNDS, longest: int = LONGEST) -> np.ndarray:
    """Where the symbols begin after the last round (indices into the part's words)."""
    sym, at, doc = w.h, np.arange(len(w.h)), w.owner()
    with np.errstate(over="ignore"):
        for r in range(rounds):
            if len(sym) < 2:
                break
            size = np.diff(at, append=len(w.h))
            # runs, in blocks of at most `longest` words
            new = np.concatenate([[True], (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])])
            if not new.all():
                head = np.flatnonzero(new)
                nth = np.arange(len(sym)) - np.repeat(head, np.diff(head, append=len(sym)))
                block = np.maximum(1, longest // np.maximum(size, 1))
                new |= nth % block == 0
                head = np.flatnonzero(new)
                many = np.diff(head, append=len(sym)).astype(np.uint64)
                sym = np.where(many > 1, mix(sym[head] + many * np.uint64(0xD6E8FEB86659FD93)), sym[head])
                at, doc = at[head], doc[head]
                size = np.diff(at, append=len(w.h))
            # pairs
            left = mix(sym + np.uint64(r + 1) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(63) == 1
            pair = np.zeros(len(sym), bool)
            pair[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= longest)
            first = np.flatnonzero(pair)
            sym = sym.copy()
            sym[first] = mix(mix(sym[first] + np.uint64(r)) * np.uint64(3) + sym[first + 1])
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, at, doc = sym[keep], at[keep], doc[keep]
    return at


def _keys(least: int):
    def make(part: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
        w = Words(part)
        at = recompress(w)
        doc = w.owner()[at]
        # each symbol with its followers until SPAN words are reached; a document's end counts as a border
        border = np.concatenate([at, [len(w.h)]])
        begin = np.arange(len(at))
        end = border[np.minimum(np.searchsorted(border, at + SPAN), len(at))] if len(at) else at
        ok = (end <= w.starts[doc + 1]) & (end - at >= SPAN) & (w.n[doc] >= least) & (end - at < 32)
        begin, end = at[begin[ok]], end[ok]
        yield from shared_keys(w, w.runs(begin, end), begin, (end - begin).astype(np.uint8), buckets)

    return make


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, copy) as described in repeats."""
    docs = unique_ids(docs)
    size = text_bytes(docs)
    places = shared_places(docs, size, _keys(least)).withColumnRenamed("doc_id", "_wl_id")
    around = docs.join(places.hint("shuffle_hash"), docs["doc_id"] == places["_wl_id"])

    def make(part: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
        w = Words(part)
        begin = near_shared(w, part.column("places"), least)
        key = w.runs(begin, begin + least)
        with np.errstate(over="ignore"):
            # a second, independent sum over the same words
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.h + np.uint64(1)) * w.power[:-1])])
            more = (mix((sums[begin + least] - sums[begin]) * w.back[begin]) >> np.uint64(33)).astype(np.uint32)
        # windows that occur before in this part are copies; the first of them stands for all
        order, copy = _ordered(key, more, w.ids[w.owner()[begin]], begin)
        again = np.zeros(len(begin), bool)
        again[order] = copy
        many = np.zeros(len(begin), bool)
        many[order[:-1]] = copy[1:]
        yield from packed(w, key, begin, more << np.uint32(1) | many.astype(np.uint32), again, buckets)

    def take(t: pa.Table) -> pa.Table:
        keys, ids, place, more = unpack(t, np.uint32)
        known, many = keys == KNOWN, (more & np.uint32(1)) > 0
        order, copy = _ordered(keys, more >> np.uint32(1), ids, place)
        copy |= known[order]
        found = copy | many[order]
        found[:-1] |= copy[1:] & ~known[order][:-1]
        at = order[found]
        return pa.Table.from_batches([grouped(ids[at], (place[at] * 2 + copy[found]).astype(np.int32), names=("marks",))])

    return spans(exchange(around, size, make, take, "doc_id long, marks array<int>", ("places",)), least)


def _ordered(key: np.ndarray, more: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by which equal windows stand together, the first of them first; which are not the first)."""
    order = np.lexsort((place, ids, more, key))
    k, m = key[order], more[order]
    return order, np.concatenate([[False], (k[1:] == k[:-1]) & (m[1:] == m[:-1])])[: len(order)]


def drop_copies(docs: DataFrame, least: int = LEAST, length: str | None = None) -> DataFrame:
    """docs with the copied words cut out of their texts; the columns stay. length: see repeats.cut."""
    return cut(docs, find(docs, least), length)
