"""What the two operators for repeated passages share.

Both answer the same question: which runs of at least `least` words occur more than once in the corpus? Each window of
`least` words has a place (document, first word). A window that occurs at several places is repeated; its occurrence
with the smallest (doc_id, start) is the first, the others are copies. The result has, for each document, the unions of
its first windows and of its copied windows: (doc_id, start, end, copy), words [start, end). Occurrences within one
document count like any others.

Both find candidates by places that equal text has in common wherever it stands, look which of these occur twice in the
corpus, and compare in full only what lies around those. Data is exchanged in packed arrays, a row for each part and
bucket, so the JVM moves few rows. What repeats within a part of a table is settled there, and a bucket hears of it once,
so a passage that a third of all documents hold is a few numbers a part. Rows with a null id are left out, null and empty texts have no windows, and of rows
that repeat an id one counts (see unique_ids).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, measured, mix, packed_rows, pieces, texts_of, unpacked, words_of

LEAST = 50

#: The definition in SQL; {least} is to be filled in.
SQL = r"""
WITH one AS (
  SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' ') AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST) AS nth FROM documents WHERE doc_id IS NOT NULL)
  WHERE nth = 1),
places AS (SELECT doc_id, words, unnest(range(0, len(words) - {least} + 1)) AS start FROM one WHERE len(words) >= {least}),
named AS (SELECT doc_id, start, array_to_string(words[start + 1 : start + {least}], ' ') AS run FROM places),
marked AS (
  SELECT doc_id, start, count(*) OVER (PARTITION BY run) AS n,
         row_number() OVER (PARTITION BY run ORDER BY doc_id, start) > 1 AS copy
  FROM named),
edges AS (
  SELECT doc_id, start, copy, coalesce(start > lag(start) OVER w + {least}, true) AS fresh
  FROM marked WHERE n > 1 WINDOW w AS (PARTITION BY doc_id, copy ORDER BY start)),
islands AS (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id, copy ORDER BY start) AS island FROM edges)
SELECT doc_id, min(start)::int AS start, (max(start) + {least})::int AS "end", copy
FROM islands GROUP BY doc_id, copy, island
"""
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
PART = 8 << 20


def unique_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text[, rest]): one row for each id that isn't null. Of rows that repeat an id, the first by text
    (null, then by value) counts, then by the rest as JSON; only such rows are shuffled for it."""
    columns = ["doc_id", "text"] + (["rest"] if docs.columns == ["doc_id", "text", "rest"] else [])
    rows = docs.where("doc_id is not null").select(*columns)
    again = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return rows
    # not all types can be ordered, but all can be written
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *(F.to_json(c).asc_nulls_first() for c in columns[2:]))
    some = rows.join(again, "doc_id", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return rows.join(again, "doc_id", "left_anti").unionByName(some)


class Words:
    """The words of a part of a table, hashed, all in one row, with sums from which any run's hash follows."""

    def __init__(self, part: pa.RecordBatch):
        words, self.starts = words_of(texts_of(part, "text"))
        self.ids = part.column("doc_id").to_numpy()
        self.h = hash_words(words)
        self.n = np.diff(self.starts)
        with np.errstate(over="ignore"):
            size = len(self.h)
            self.power = np.ones(size + 1, np.uint64)
            self.back = np.ones(size + 1, np.uint64)
            if size:
                self.power[1:] = np.multiply.accumulate(np.full(size, _BASE, np.uint64))
                self.back[1:] = np.multiply.accumulate(np.full(size, _INVERSE, np.uint64))
            self.sums = np.zeros(size + 1, np.uint64)
            np.cumsum(self.h * self.power[:-1], out=self.sums[1:])

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs [begin, end): equal for equal runs wherever they stand."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * _BASE)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.n)


#: Bytes of text whose keys share a bucket.
BUCKET = 16 << 20
PACKED = "bucket int, base long, keys binary, near binary, far binary, places binary, extra binary"
#: The key of what is already known and only travels to be grouped by document.
KNOWN = np.uint64(0)


def _binary(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """x cut at starts (the last of which is its end), each piece as bytes."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * x.itemsize).astype(np.int32)), pa.py_buffer(x.view(np.uint8) if len(x) else b"")])


def packed(w: Words, keys: np.ndarray, places: np.ndarray, extra: np.ndarray, known: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with the keys of this part that belong there, and their documents and places. Of places that
    are known only the values travel, to a bucket of their document."""
    if not len(keys):
        return
    doc = np.searchsorted(w.starts, places, "right") - 1
    ids, place = w.ids[doc], (places - w.starts[doc]).astype(np.uint32)
    keys = np.where(known, KNOWN, np.maximum(keys, np.uint64(1)))
    bucket = (np.where(known, mix(ids.view(np.uint64)), keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, ids, place, extra = bucket[order], keys[order], ids[order], place[order], extra[order]
    starts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(keys))
    none = np.zeros(len(starts), np.int64)
    base, most = int(ids.min()), int(ids.max())
    small = most - base < 1 << 32
    yield pa.RecordBatch.from_arrays([
        pa.array(bucket[starts[:-1]], pa.int32()), pa.array(np.full(len(starts) - 1, base)), _binary(keys, starts),
        _binary((ids - base).astype(np.uint32), starts) if small else _binary(ids[:0], none), _binary(ids[:0], none) if small else _binary(ids, starts),
        _binary(place, starts), _binary(extra, starts),
    ], names=["bucket", "base", "keys", "near", "far", "places", "extra"])


def _flat(t: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of packed rows, how many there are in each row)."""
    values, counts = [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
    for c in t.column(name).chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            if at[-1] > at[0]:
                values.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype))
            counts.append(np.diff(at) // np.dtype(dtype).itemsize)
    return np.concatenate(values), np.concatenate(counts)


def unpack(t: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc_id, place within the document, extra) of all keys of a bucket."""
    keys, n = _flat(t, "keys", np.uint64)
    near, small = _flat(t, "near", np.uint32)
    ids = np.empty(len(keys), np.int64)
    short = np.repeat(small > 0, n)
    ids[short] = near.astype(np.int64) + np.repeat(t.column("base").to_numpy(), small)
    ids[~short] = _flat(t, "far", np.int64)[0]
    return keys, ids, _flat(t, "places", np.uint32)[0].astype(np.int64), _flat(t, "extra", kind)[0]


def grouped(ids: np.ndarray, *values: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    """A row for each id, with the lists of its values."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = pa.array(np.append(new, len(ids)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(ids[new], pa.int64()), *lists], names=["doc_id", *names])


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else same
    return out


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def exchange(docs: DataFrame, size: int, make: Callable[[Words, int], Iterator[pa.RecordBatch]], take: Callable[[pa.Table], pa.Table], returns: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Sends what `make` packs of each part to its bucket, and what `take` finds in a bucket on. Buckets are as many as
    the bytes of text (size) ask for, whatever the number of shuffle partitions."""
    buckets = min((1 << 31) - 1, size // BUCKET + 1)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PART):
                yield from make(part, buckets)

    return docs.select("doc_id", "text", *columns).mapInArrow(out, PACKED).groupBy("bucket").applyInArrow(take, returns)


def shared_keys(w: Words, keys: np.ndarray, places: np.ndarray, extra: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys, to find out which occur twice in the corpus. Those that do in this part are known to, and all their places
    are sent on; of each key one place goes to the key's bucket, so however common a key is, a bucket gets it once from
    each part."""
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    here, send = twice(keys), np.zeros(len(keys), bool)
    send[order[first]] = True
    at = np.concatenate([np.flatnonzero(send), np.flatnonzero(here)])
    yield from packed(w, keys[at], places[at], extra[at], np.arange(len(at)) >= send.sum(), buckets)


def is_shared(keys: np.ndarray) -> np.ndarray:
    return twice(keys) | (keys == KNOWN)


def shared_places(docs: DataFrame, size: int, make: Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(doc_id, places): for each document with keys that occur twice in the corpus, their places and spans, packed
    as place * 32 + span (extra: the span)."""

    def take(t: pa.Table) -> pa.Table:
        keys, ids, place, span = unpack(t, np.uint8)
        hit = is_shared(keys)
        return pa.Table.from_batches([grouped(ids[hit], (place[hit] << 5 | span[hit]).astype(np.int32), names=("places",))])

    found = exchange(docs, size, make, take, "doc_id long, places array<int>")
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))


def near_shared(w: Words, places: pa.Array, least: int) -> np.ndarray:
    """Where the windows begin that hold a shared key (indices into the part's words)."""
    flat = places.values.to_numpy()[places.offsets[0].as_py() :][: places.offsets[-1].as_py() - places.offsets[0].as_py()].astype(np.int64)
    n = np.diff(places.offsets.to_numpy())
    doc = np.repeat(np.arange(len(n)), n)
    begin = (flat >> 5) + w.starts[doc]
    lo = np.maximum(begin + (flat & 31) - least, w.starts[doc])
    hi = np.minimum(begin, w.starts[doc + 1] - least)
    ok = lo <= hi
    change = np.bincount(lo[ok], minlength=len(w.h) + 2)[: len(w.h) + 2].astype(np.int64)
    change -= np.bincount(hi[ok] + 1, minlength=len(w.h) + 2)[: len(w.h) + 2]
    return np.flatnonzero(np.cumsum(change) > 0)


def spans(found: DataFrame, least: int) -> DataFrame:
    """found: (doc_id, marks): starts of repeated windows, each as start * 2 + (1 if it is a copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("marks")
            first = lists.offsets[0].as_py() if b.num_rows else 0
            flat = lists.values.to_numpy()[first:].astype(np.int64)[: int(lists.offsets[-1].as_py() - first) if b.num_rows else 0]
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            start, copy = flat >> 1, flat & 1
            order = np.lexsort((start, copy, row))
            row, start, copy = row[order], start[order], copy[order]
            if not len(row):
                continue
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > start[:-1] + least)])
            last = np.concatenate([new[1:], [True]])
            ids = b.column("doc_id").to_numpy()[row[new]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start[new], pa.int32()), pa.array((start[last] + least), pa.int32()), pa.array(copy[new] == 1)], names=["doc_id", "start", "end", "copy"])

    joined = found.groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    return joined.mapInArrow(run, "doc_id long, start int, end int, copy boolean")


def cut(docs: DataFrame, found: DataFrame, length: str | None = None) -> DataFrame:
    """docs without their copied words: what remains is joined by the white space that preceded it. Documents of
    which nothing remains go; those without copies, and rows with a null id, stay as they are. length: a column of whole
    numbers that holds the text's length and follows it."""
    columns, rows = docs.columns, packed_rows(docs)
    runs = found.where("copy").groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    joined = unique_ids(rows).join(runs, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "rest", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, copied = part.column("text"), part.column("runs").is_valid()
                new = [remaining(t, r) for t, r in zip(texts.filter(copied).to_pylist(), part.column("runs").filter(copied).to_pylist())]
                if new:
                    new = pa.array([t or None for t in new], texts.type)
                    texts = pc.replace_with_mask(texts, copied, new)
                    keep = pc.or_(texts.is_valid(), pc.invert(copied))
                    part, texts = part.filter(keep), texts.filter(keep)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, part.column("rest")], names=["doc_id", "text", "rest"])

    return measured(unpacked(joined.mapInArrow(run, rows.schema), columns).unionByName(docs.where("doc_id is null")), length)


def remaining(text: str, runs: list[dict]) -> str:
    """text without the words in runs (sorted, by word number)."""
    import re

    at = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\v\f]+", text)]
    out, last, kept = [], 0, False
    for r in runs:
        i, j = r["start"], min(r["end"], len(at))
        if last < i:
            out.append(text[(at[last - 1][1] if last and kept else at[last][0] if last else 0) : at[i - 1][1]])
            kept = True
        last = max(last, j)
    if last < len(at):
        out.append(text[(at[last - 1][1] if last and kept else at[last][0] if last else 0) :])
    return "".join(out)
