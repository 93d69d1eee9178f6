"""Token-ID / binary output: frequency-ranked ids, byte-aligned, with the control bytes apart from the data bytes.

Texts are tokenised once with a public byte-level BPE vocabulary, and the ids written to a table. How often each id
occurs is counted over all documents (one array of the vocabulary's size per task), ids are ranked by falling count
(ties: the smaller id first), so the commonest tokens have the smallest ranks, and each document's ranks are written
with one to four bytes each: two bits a rank, four to a control byte, say how many, and the bytes themselves, smallest
first, follow in a stream of their own. Decoding looks each control byte up in a table of 256 rows for the four lengths
and gathers the bytes with numpy. The ranking is as large as the vocabulary, whatever the size of the corpus.

Result: (doc_id, n_tokens, control, data, ranks), one row for each row of docs; ranks is the path of the table (rank, id)
in the shared folder, with which the streams are decoded. Edge cases: null and empty texts have no
tokens and empty streams; rows with a null doc_id are kept with it; repeated rows are coded alike and counted each
time; very long texts and runs of one kind of character are tokenised whole; an empty table gives an empty result;
extra columns aren't read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, pieces, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space from which they are set apart before a text is tokenised: the tokeniser's pattern can't take any length.
RUN = 10_000


def ship(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary along to the executors; returns its path for `ranks_of`."""
    spark.sparkContext.addFile(path)
    return path


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary at path or, where that doesn't exist, the file of its name that the driver sent."""
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(1)
def _long_runs():
    import regex

    return regex.compile(rf"\s{{{RUN},}}").finditer


def ids_of(coder, text: str) -> list[int]:
    """The text's token ids. A long run of white space is a token of PATTERN by itself but for its last character, which
    may belong to what follows."""
    if len(text) < RUN:
        return coder.encode_ordinary(text)
    out, at = [], 0
    for m in _long_runs()(text):
        end = m.end() - (m.end() < len(text))
        out += coder.encode_ordinary(text[at : m.start()]) + coder._encode_single_piece(text[m.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:])


# ---- the code -------------------------------------------------------------------------------------------------

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode(values: np.ndarray, ends: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) for each of the lists values[ends[i-1]:ends[i]]."""
    v = np.ascontiguousarray(values, dtype="<u4")
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    grid = v.view(np.uint8).reshape(-1, 4)
    data = grid[np.arange(4) <= more[:, None]]
    data_end = np.concatenate([[0], np.cumsum(more.astype(np.int64) + 1)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - starts
    slots = -(-n // 4) * 4
    slot_start = np.concatenate([[0], np.cumsum(slots)]).astype(np.int64)
    padded = np.zeros(int(slot_start[-1]), np.uint8)
    padded[np.arange(len(v)) + np.repeat(slot_start[:-1] - starts, n)] = more
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    control, data = control.tobytes(), data.tobytes()
    return [(control[slot_start[i] // 4 : slot_start[i + 1] // 4], data[data_end[s] : data_end[e]]) for i, (s, e) in enumerate(zip(starts, ends))]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
    grid = raw[at[:, None] + np.arange(4)]
    grid[np.arange(4) >= lengths[:, None]] = 0
    return np.ascontiguousarray(grid).view("<u4").ravel()


# ---- over a table ---------------------------------------------------------------------------------------------


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                got = [np.array(ids_of(coder, t), np.uint32) for t in texts_of(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in got], pa.int32()), pa.array([x.tobytes() if x.size and x.max() > 0xFFFF else x.astype(np.uint16).tobytes() for x in got], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch (stored with two bytes where they fit, else four) and where each document's end."""
    n = b.column("n_tokens").to_numpy().astype(np.int64)
    raw = b.column("ids")
    got = [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32).astype(np.int64) for x, k in zip(raw.to_pylist(), n)]
    return np.concatenate(got) if got else np.zeros(0, np.int64), np.cumsum(n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for b in pieces(batch, "ids", 1 << 20):
            more = np.bincount(_ids(b)[0], minlength=len(total))
            more[: len(total)] += total
            total = more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _code(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "ids", 1 << 20):
                ids, ends = _ids(b)
                got = encode(ranks[ids], ends)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array([c for c, _ in got], pa.binary()), pa.array([d for _, d in got], pa.binary())], names=["doc_id", "n_tokens", "control", "data"])

    return run


def encode_table(docs: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_tokens, control, data, ranks), and for each rank the id that has it."""
    tables = Written(docs.sparkSession)
    path = ship(docs.sparkSession, path)
    ids = tables.put("ids", docs.select("doc_id", "text").mapInArrow(_tokenise(path), "doc_id long, n_tokens int, ids binary"))
    counts = ids.mapInArrow(_count, "id long, n long").groupBy("id").sum("n").toArrow()  # at most one row an id
    size = max(ranks_of(path).values()) + 1
    n = np.zeros(size, np.int64)
    n[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    by_rank = np.argsort(-n, kind="stable")
    ranks = np.empty(size, np.uint32)
    ranks[by_rank] = np.arange(size, dtype=np.uint32)
    tables.put("ranks", docs.sparkSession.createDataFrame(pa.table({"rank": np.arange(size), "id": by_rank})), stays=True)
    return ids.mapInArrow(_code(ranks), "doc_id long, n_tokens int, control binary, data binary").withColumn("ranks", F.lit(tables.paths["ranks"])), by_rank
