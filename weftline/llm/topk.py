"""Exact top-k search in three phases with a uniform threshold.

The queries are the rows whose id is divisible by `every`; each is held against all rows. The cost of a vector for a
query is their squared distance, the sum of its costs in SLICES groups of dimensions, each of which is a list to search.
If k vectors are known to cost at most c, every one of the k best costs at most c / SLICES in some list. So:

1. the lists of the query's home segment give the k entries with the least costs in each, and only their totals are
   computed;
2. the k-th smallest of these totals is a safe cutoff c, which is sent to all lists. A segment whose centre and radii
   in the lists show that all it holds costs more is not read; of the others each list returns all entries up to
   c / SLICES: these are sufficient;
3. only of these the remaining costs are added; those up to c are resolved exactly (64 bits), and the k best are the
   answer.

Rows lie with the nearest of at most LEADERS leaders (a sample by hash), and what lies with one leader is cut into
segments of about SEGMENT rows by a hash, so a hot group is many segments. Leaders only steer how much is read.
Queries and segments travel in packed blocks; what is broadcast or sent to the driver is checked against BROADCAST, and
beyond it blocks are joined by a shuffle, or every segment is read.

Result: (query_id, rank, vec_id, distance), Euclidean, rounded to six places; ties (equal distances) go to the smaller
id; a query isn't its own neighbour. With fewer than k others there are fewer rows; what counts as a row, nulls and
repeated ids among them, is described in vectors.valid; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written
from .vectors import bucket_of, matrix, valid

K, SLICES, EVERY = 10, 2, 100
#: Queries in a block, vectors in a segment of the table, leaders that segments lie around.
BLOCK, SEGMENT, LEADERS = 1024, 8192, 1024
#: Bytes of packed vectors up to which a side is broadcast.
BROADCAST = 64 << 20
#: Partial results that are merged at a time.
MERGE = 64

SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::int AS rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}
"""

RESULT = "query_id long, rank int, vec_id long, distance double"
_PARTIAL = "q int, g int, who binary, found binary, cost binary, totals long"


def _costs(q: np.ndarray, v: np.ndarray, cuts: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    for a, b in cuts:
        x, y = q[:, a:b], v[:, a:b]
        yield np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def _read(row: dict, side: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_vectors"], np.float32).reshape(-1, dim)


def _best(cost: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k smallest."""
    return np.argpartition(cost, k - 1, axis=1)[:, :k] if cost.shape[1] > k else np.broadcast_to(np.arange(cost.shape[1]), cost.shape)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _pack(key: str, dim: int, cuts: list[tuple[int, int]]):
    """A block's vectors in one row, with their centre and the radius around it in each list."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["id"].to_numpy()
        order = np.argsort(ids)
        v = matrix(t["v"].chunk(0), dim)[order]
        centre = v.mean(0, dtype=np.float64)
        radii = [np.sqrt(((v[:, a:b] - centre[a:b]) ** 2).sum(1)).max() for a, b in cuts]
        return pa.table({key: t[key][:1], "home": t["home"][:1], "ids": [ids[order].tobytes()], "vectors": [v.tobytes()], "centre": [centre.tobytes()], "radii": [np.array(radii).tobytes()]})

    return pack


def _place(leaders: np.ndarray, dim: int):
    """The cell (nearest leader) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (leaders * leaders).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((norms - 2 * (matrix(b.column("v"), dim) @ leaders.T)).argmin(1).astype(np.int32))], names=["id", "v", "cell"])

    return run


def _blocks(rows: DataFrame, key: str, parts: np.ndarray, home: np.ndarray, dim: int, cuts: list[tuple[int, int]]) -> DataFrame:
    """The rows packed: those of cell c in parts[c] blocks."""
    first = np.concatenate([[0], np.cumsum(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            block = first[cell] + bucket_of(b.column("id").to_numpy(), 1 << 31) % parts[cell]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(block, pa.int32()), pa.array(home[cell], pa.int32())], names=["id", "v", key, "home"])

    return rows.mapInArrow(run, f"id long, v array<float>, {key} int, home int").groupBy(key).applyInArrow(_pack(key, dim, cuts), f"{key} int, home int, ids binary, vectors binary, centre binary, radii binary")


def _merge(k: int, final: bool):
    def merge(t: pa.Table) -> pa.Table:
        who, found = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t[c]]) for c in ("who", "found"))
        cost = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in t["cost"]])
        order = np.lexsort((found, cost, who))
        who, found, cost = who[order], found[order], cost[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        ok = rank <= k
        if final:
            return pa.table({"query_id": who[ok], "rank": rank[ok].astype(np.int32), "vec_id": found[ok], "distance": np.round(np.sqrt(cost[ok]), 6)})
        return pa.table({"q": t["q"][:1], "g": t["g"][:1], "who": [who[ok].tobytes()], "found": [found[ok].tobytes()], "cost": [cost[ok].tobytes()], "totals": [sum(t["totals"].to_pylist())]})

    return merge


def search(table: DataFrame, k: int = K, every: int = EVERY, slices: int = SLICES, broadcast: int = BROADCAST, segment: int = SEGMENT) -> DataFrame:
    got = _sufficient(table, k, every, slices, broadcast, segment)
    if got is None:
        return table.sparkSession.createDataFrame([], RESULT)
    found, groups = got
    while groups > MERGE:
        groups = ceil(groups / MERGE)
        found = found.withColumn("g", F.col("g") % groups).groupBy("q", "g").applyInArrow(_merge(k, False), _PARTIAL)
    return found.groupBy("q").applyInArrow(_merge(k, True), RESULT)


def _sufficient(table: DataFrame, k: int, every: int, slices: int, broadcast: int, segment: int) -> tuple[DataFrame, int] | None:
    """(the k best of each segment for each block of queries as _PARTIAL, number of segments); totals: how many total
    costs were computed for it."""
    spark = table.sparkSession
    tables = Written(spark)
    rows, dim = valid(table)
    rows = tables.put("rows", rows)
    n = rows.count()
    if not n:
        return None
    slices = max(1, min(slices, dim))
    edges = np.linspace(0, dim, slices + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))

    leaders = rows.orderBy(F.xxhash64("id"), "id").limit(min(LEADERS, ceil(n / segment))).toArrow().combine_chunks()
    leaders = matrix(leaders["v"].chunk(0), dim)
    placed = tables.put("placed", rows.mapInArrow(_place(leaders, dim), "id long, v array<float>, cell int"))
    asked = F.pmod("id", F.lit(every)) == 0
    sizes = np.zeros((len(leaders), 2), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if(asked).alias("asked")).collect():  # at most LEADERS rows
        sizes[r["cell"]] = r["rows"], r["asked"]
    if not sizes[:, 1].sum():
        return None
    parts, asks = (np.maximum(1, -(-sizes[:, i] // size)) for i, size in enumerate((segment, BLOCK)))
    home = np.concatenate([[0], np.cumsum(parts)])[:-1]
    segments = tables.put("segments", _blocks(placed, "s", parts, home, dim, cuts).drop("home")).selectExpr("s", "ids AS s_ids", "vectors AS s_vectors", "centre", "radii")
    queries = _blocks(placed.where(asked), "q", asks, home, dim, cuts).selectExpr("q", "home", "ids AS q_ids", "vectors AS q_vectors")
    loaded = segments.select("s", "s_ids", "s_vectors")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the k best entries of each list at home, and the k-th smallest of their totals."""
        for row in _rows(batches):
            ids, q = _read(row, "q", dim)
            others, v = _read(row, "s", dim) if row["s_ids"] else (ids[:0], q[:0])  # a hash may have left home empty
            own = ids[:, None] == others
            chosen = np.zeros(own.shape, bool)
            for cost in _costs(q, v, cuts):
                cost[own] = np.inf
                np.put_along_axis(chosen, _best(cost, k), True, axis=1)
            i, j = np.nonzero(chosen & ~own)
            total = np.full((len(ids), k * slices), np.inf)
            total[i, np.arange(len(i)) - np.searchsorted(i, i)] = ((q[i].astype(np.float64) - v[j].astype(np.float64)) ** 2).sum(1)
            cutoffs = np.partition(total, k - 1, axis=1)[:, k - 1]  # infinite where home has fewer than k others
            yield pa.RecordBatch.from_pydict({"q": pa.array([row["q"]], pa.int32()), "q_ids": [row["q_ids"]], "q_vectors": [row["q_vectors"]], "cutoffs": [cutoffs.tobytes()]})

    cutoffs = tables.put("cutoffs", queries.join(loaded, F.col("home") == F.col("s"), "left").mapInArrow(gather, "q int, q_ids binary, q_vectors binary, cutoffs binary"))

    # centres and radii of all segments, if they are few enough; else every segment is read
    count = int(parts.sum())
    bounds = None
    if count * 8 * (dim + slices + 1) <= broadcast:
        got = segments.select("s", "centre", "radii").toArrow()
        bounds = (got["s"].to_numpy(), *(np.frombuffer(b"".join(got[c].to_pylist()), np.float64).reshape(len(got), -1) for c in ("centre", "radii")))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 2: the segments that may hold an entry within the cutoff of a query of the block."""
        for row in _rows(batches):
            if bounds is None:
                want = np.arange(count)
            else:
                names, centres, radii = bounds
                q = _read(row, "q", dim)[1].astype(np.float64)
                limit = np.frombuffer(row["cutoffs"], np.float64) * (1 + 1e-9) + 1e-9
                some = np.zeros(len(names), bool)
                for at in range(0, len(q), 64):
                    least = np.zeros((len(q[at : at + 64]), len(names)))
                    for (a, b), radius in zip(cuts, radii.T):
                        x, y = q[at : at + 64, a:b], centres[:, a:b]
                        apart = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))
                        least += np.maximum(apart - radius - 1e-6 * (1 + apart), 0) ** 2
                    some |= (least <= limit[at : at + 64, None]).any(0)
                want = names[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(want), row["q"]), pa.int32()), pa.array(want, pa.int32())], names=["q", "s"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: sufficient entries, their totals, and the exact costs of those still in question."""
        for row in _rows(batches):
            (ids, q), (others, v) = _read(row, "q", dim), _read(row, "s", dim)
            # a margin for 32-bit arithmetic
            limit = (np.frombuffer(row["cutoffs"], np.float64) * (1 + 1e-5) + 1e-5 * (1 + (q * q).sum(1)))[:, None]
            left, right, totals = [], [], 0
            for at in range(0, len(others), BLOCK):
                enough = np.zeros((len(q), len(others[at : at + BLOCK])), bool)
                for cost in _costs(q, v[at : at + BLOCK], cuts):
                    enough |= cost <= limit / slices
                i, j = np.nonzero(enough)
                totals += len(i)
                for x in range(0, len(i), 1 << 17):
                    a, b = i[x : x + (1 << 17)], at + j[x : x + (1 << 17)]
                    ok = (((q[a] - v[b]) ** 2).sum(1) <= limit[a, 0]) & (ids[a] != others[b])
                    left.append(a[ok])
                    right.append(b[ok])
            i, j = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
            exact = np.empty(len(i))
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                exact[at : at + (1 << 16)] = ((q[a].astype(np.float64) - v[b].astype(np.float64)) ** 2).sum(1)
            order = np.lexsort((others[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pa.RecordBatch.from_pydict({"q": pa.array([row["q"]], pa.int32()), "g": pa.array([row["s"]], pa.int32()), "who": [ids[i[ok]].tobytes()], "found": [others[j[ok]].tobytes()], "cost": [exact[ok].tobytes()], "totals": [totals]})

    pairs = tables.put("pairs", cutoffs.mapInArrow(needed, "q int, s int"))
    tables.keep("segments", "cutoffs", "pairs")
    hint = F.broadcast if n * (4 * dim + 8) <= broadcast else (lambda x: x)
    # few pairs a task: each carries a block and a segment
    spread = pairs.repartition(max(1, ceil(pairs.count() / 4)), "q", "s")
    return spread.join(hint(loaded), "s").join(hint(cutoffs), "q").mapInArrow(resolve, _PARTIAL), count
