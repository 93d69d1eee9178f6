"""Embedding near-dedup by NN-descent.

Vectors of equal direction are put together first; what follows works on one of each, the *points*, and counts the
others with it. A graph of each point's K most similar others is refined from a first guess (points with equal signs
under a few random hyperplanes). In a round every point meets the neighbours of its neighbours: each node gathers its
neighbours and those that have it as a neighbour, pairs of them of which one is new are compared, and pairs that improve
a list enter it. Rounds go on while they find new pairs above the threshold. A list that is saturated, full of
neighbours above the threshold, is enlarged to twice its length in the same round.

Threshold edges are then verified in 64 bits on the 32-bit unit vectors; their connected components are the classes.
Lists that are saturated even so are enlarged to all saturated points of their class. To count links there without
going through all pairs, the points of a large class are put to the nearest of some leaders (about m / CELL, 4 sqrt(m)
at most). Angles obey the triangle inequality, so two such cells whose leaders and radii leave no doubt count as linked
or apart as a whole, and only the rest is compared, block by block. So a group of near-copies costs m^1.5, not m^2, and
no pair is ever written.

The result's recall is audited. Samples of points (by a hash of the id) are drawn, and all their true links counted by
brute force, until ENOUGH of them have links and unsaturated lists, or the whole table is drawn. A point's recall is the
share found of its own links. The mean over points with saturated lists and that over the others must each reach TARGET.
While they don't, the graph is refined further with another guess and lists twice as long; after TRIES of that all pairs
of the table are compared, block by block, and the result is exact.

Points and lists are exchanged as packed arrays between buckets of ids; nothing that grows with the table is
broadcast. A node that many points of one bucket go to (HOT) is split into groups of about MEET, other ones each round,
and each bucket passes on at most HUB of those that have it as neighbour. That bounds a task, and only steers the search:
what it misses shows in the audit.

Result: (vec_id, class_id, links): a row for each vector, with the smallest id of its class (its own where it has no
link) and the number of other vectors whose cosine with it is >= threshold. Edge cases: zero vectors have no direction
and are left out, further see vectors.valid; equal vectors are linked like others; ties between similarities are broken
by a hash; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, mix
from .components import components, forest
from .vectors import bucket_of, by_bucket, matrix, valid

THRESHOLD = 0.95
K = 12
#: At least so many tables a guess, and as many as let a pair at the threshold meet in one with this probability.
GUESSES, GUESS_SIZE, MEETS = 4, 16, 0.95
#: Members of a node that meet at a time; local members from which a node is split; local followers that are passed on.
MEET, HOT, HUB = 128, 8, 64
#: Points of the first sample (later ones are up to AUDIT_MOST times as large), and those needed with unsaturated lists.
AUDIT, AUDIT_MOST, ENOUGH, TARGET, TRIES = 1024, 8, 512, 0.95, 4
#: Similarities in the graph come from 16 bits an element and may be off by this.
SLACK = 0.01
#: Points a leader in a large class, and points of a block that is compared at once.
CELL, BLOCK = 1024, 4096
#: Angles are trusted up to this.
DOUBT = 1e-3

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
SELECT a AS vec_id, min(b) AS class_id, (SELECT count(*) FROM near WHERE near.a = reach.a) AS links FROM reach GROUP BY a
"""

VECTORS, EDGES, REVERSE, MEMBERS, ASK, REPLY = range(6)
ROW = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["bucket", "kind", "a", "b", "c", "d", "e"]
_EDGE = (np.int64, np.int64, np.float32, np.uint8)


def _batch(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32())]
    columns += [pa.array([r[i] if len(r) > i else None for r in rows], pa.binary()) for i in range(1, 6)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _table(*batches: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches(batches)


def _cat(t: pa.Table, kind: int, column: str, dtype, width: int = 0) -> np.ndarray:
    got = [np.frombuffer(x.as_buffer(), dtype) for k, x in zip(t["kind"].to_pylist(), t[column]) if k == kind]
    out = np.concatenate(got) if got else np.zeros(0, dtype)
    return out.reshape(-1, width) if width else out


def _edges(t: pa.Table) -> list[np.ndarray]:
    return [_cat(t, EDGES, c, x) for c, x in zip("abcd", _EDGE)]


def _points(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, unit vectors, copies) of a bucket, by id."""
    ids = _cat(t, VECTORS, "a", np.int64)
    order = np.argsort(ids)
    return ids[order], _cat(t, VECTORS, "b", np.float32, dim)[order], _cat(t, VECTORS, "c", np.int64)[order]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys differ from the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


# ---- points ---------------------------------------------------------------------------------------------------


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), dim).astype(np.float64)
                v /= np.abs(v).max(1)[:, None]
                v = (v / np.sqrt((v * v).sum(1))[:, None] + 0.0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "v"])

    return run


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _pack(buckets: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy()
                yield _batch(VECTORS, list(by_bucket(bucket_of(ids, buckets), ids, _units(b.column("v"), dim), b.column("copies").to_numpy())))

    return run


# ---- the graph ------------------------------------------------------------------------------------------------


def _guesses(bits: int, threshold: float) -> int:
    """Tables of a guess: the more signs must be equal, the more are needed."""
    equal = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return GUESSES if equal >= MEETS else max(GUESSES, ceil(log(1 - MEETS) / log1p(-max(equal, 1e-9))))


def _spread(centre: np.ndarray, who: np.ndarray, buckets: int, seed: int) -> np.ndarray:
    """Names of nodes, of which those that HOT or more of these points go to are split by a hash of the point: into as
    many parts as make groups of about MEET if it is so in all buckets."""
    _, at, count = np.unique(centre, return_inverse=True, return_counts=True)
    power = np.where(count > HOT, np.ceil(np.log2(np.maximum(count * buckets / MEET, 1))), 0).astype(np.uint64)[at]
    with np.errstate(over="ignore"):
        salt = mix(who.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) & ((np.uint64(1) << power) - np.uint64(1))
        return np.where(power > 0, mix(centre.view(np.uint64) ^ mix(salt * np.uint64(64) + power + np.uint64(1 << 40))), centre.view(np.uint64)).view(np.int64)


def _guess(buckets: int, dim: int, bits: int, guesses: int, seed: int):
    """First lists: points with the same signs meet."""
    planes = np.random.default_rng(seed).standard_normal((guesses, dim, bits)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v in zip(b.column("a"), b.column("b")):
                ids, v = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.float32).reshape(-1, dim)
                for g in range(guesses):
                    signs = (v @ planes[g] > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                    centre = _spread(signs * guesses + g, ids, buckets, seed * 1024 + g)
                    yield _batch(MEMBERS, list(by_bucket(bucket_of(centre, buckets), centre, ids, v.astype(np.float16), np.full(len(ids), -2, np.float32), np.ones(len(ids), np.uint8))))

    return run


def _reverse(buckets: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, d in zip(*(batch.column(c) for c in "abd")):
                a, b, d = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64), np.frombuffer(d.as_buffer(), np.uint8)
                with np.errstate(over="ignore"):
                    order = np.lexsort((mix(a.view(np.uint64) + np.uint64(seed)), b))
                a, b, d = a[order], b[order], d[order]
                ok = np.arange(len(b)) - np.searchsorted(b, b) < HUB
                yield _batch(REVERSE, list(by_bucket(bucket_of(b[ok], buckets), b[ok], a[ok], d[ok])))

    return run


def _state(ids: np.ndarray, a: np.ndarray, sim: np.ndarray, k: int, close: float) -> tuple[np.ndarray, np.ndarray]:
    """(what a similarity must exceed to enter each list, which lists are saturated)."""
    at = np.searchsorted(ids, a)
    n, least = np.bincount(at, minlength=len(ids)), np.full(len(ids), 2, np.float32)
    np.minimum.at(least, at, sim)
    full = (n >= 2 * k) & (least >= close)
    worst = np.select([n < k, least < close, ~full], [-2, least, close - 1e-6], 2).astype(np.float32)
    return worst, full


def _send(buckets: int, dim: int, k: int, close: float, seed: int):
    """Each point goes to the nodes in its list and to those that have it in theirs."""

    def take(t: pa.Table) -> pa.Table:
        ids, v, _ = _points(t, dim)
        a, b, sim, new = _edges(t)
        worst, _ = _state(ids, a, sim, k, close)
        who = np.concatenate([np.searchsorted(ids, a), np.searchsorted(ids, _cat(t, REVERSE, "a", np.int64))])
        centre = np.concatenate([b, _cat(t, REVERSE, "b", np.int64)])
        new = np.concatenate([new, _cat(t, REVERSE, "c", np.uint8)])
        order = np.lexsort((-new.astype(np.int8), centre, who))
        who, centre, new = who[order], centre[order], new[order]
        first = _firsts(who, centre)
        who, centre, new = who[first], centre[first], new[first]
        centre = _spread(centre, ids[who], buckets, seed)
        return _table(_batch(MEMBERS, list(by_bucket(bucket_of(centre, buckets), centre, ids[who], v[who].astype(np.float16), worst[who], new))))

    return take


def _meet(buckets: int, dim: int, seed: int):
    """Pairs of the members of each node of which one is new; those that improve a list go to its bucket."""

    def take(t: pa.Table) -> pa.Table:
        centre, who = _cat(t, MEMBERS, "a", np.int64), _cat(t, MEMBERS, "b", np.int64)
        v, worst, new = _cat(t, MEMBERS, "c", np.float16, dim), _cat(t, MEMBERS, "d", np.float32), _cat(t, MEMBERS, "e", np.uint8)
        with np.errstate(over="ignore"):
            order = np.lexsort((mix(who.view(np.uint64) + centre.view(np.uint64) * np.uint64(3) + np.uint64(seed)), centre))
        centre, who, worst, new, v = centre[order], who[order], worst[order], new[order] > 0, v[order]
        head = np.flatnonzero(_firsts(centre))
        nth = np.arange(len(centre)) - np.repeat(head, np.diff(head, append=len(centre)))
        head = np.flatnonzero(nth % MEET == 0)
        size = np.diff(head, append=len(centre))
        later = np.repeat(head + size, size) - np.arange(len(centre)) - 1  # members after each in its group
        ends, at, out = np.cumsum(later), 0, []
        while at < len(centre):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
            n = later[at:end]
            x = np.repeat(np.arange(at, end), n)
            y = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + x + 1
            ok = (new[x] | new[y]) & (who[x] != who[y]) & (np.minimum(worst[x], worst[y]) < 1.5)
            x, y = x[ok], y[ok]
            sim = np.einsum("ij,ij->i", v[x].astype(np.float32), v[y].astype(np.float32))
            for p, q in ((x, y), (y, x)):
                better = sim > worst[p]
                out.append((who[p[better]], who[q[better]], sim[better]))
            at = end
        a, b, sim = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        order = np.lexsort((b, a))
        a, b, sim = a[order], b[order], sim[order]
        one = _firsts(a, b)
        a, b, sim = a[one], b[one], sim[one]
        return _table(_batch(EDGES, list(by_bucket(bucket_of(a, buckets), a, b, sim, np.ones(len(a), np.uint8)))))

    return take


def _merge(k: int, close: float):
    """The k most similar of each node's old and new neighbours, twice as many of those above the threshold; only what
    wasn't there before counts as new."""

    def take(t: pa.Table) -> pa.Table:
        a, b, sim, new = _edges(t)
        order = np.lexsort((new, b, a))
        a, b, sim, new = a[order], b[order], sim[order], new[order]
        one = _firsts(a, b)
        a, b, sim, new = a[one], b[one], sim[one], new[one]
        with np.errstate(over="ignore"):
            order = np.lexsort((mix(b.view(np.uint64) + a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), -sim, a))
        a, b, sim, new = a[order], b[order], sim[order], new[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        ok = (nth < k) | ((nth < 2 * k) & (sim >= close))
        return _table(_batch(EDGES, [(t["bucket"][0].as_py(), a[ok].tobytes(), b[ok].tobytes(), sim[ok].tobytes(), new[ok].tobytes())]))

    return take


def _old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = pa.array([bytes(len(x.as_buffer())) for x in b.column("d")], pa.binary())
        yield pa.RecordBatch.from_arrays([d if c == "d" else b.column(c) for c in _NAMES], names=_NAMES)


def _lists(batch: pa.RecordBatch) -> Iterator[tuple]:
    for bucket, *x in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in "abcd")):
        yield bucket, *(np.frombuffer(y.as_buffer(), d) for y, d in zip(x, _EDGE))


def _fresh(k: int, close: float):
    """Nodes of unsaturated lists with a new neighbour above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, a, _, sim, new in _lists(batch):
                ids = np.unique(a)
                _, full = _state(ids, a, sim, k, close)
                ok = (sim >= close) & (new > 0) & ~full[np.searchsorted(ids, a)]
                yield pa.RecordBatch.from_arrays([pa.array(a[ok])], names=["id"])

    return run


def _saturated(k: int, close: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, a, _, sim, _ in _lists(batch):
                ids = np.unique(a)
                yield pa.RecordBatch.from_arrays([pa.array(ids[_state(ids, a, sim, k, close)[1]])], names=["id"])

    return run


# ---- threshold edges ------------------------------------------------------------------------------------------


def _ask(buckets: int, close: float):
    """What a bucket needs to verify its edges, once for each point whatever the number of lists it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, _, b, sim, _ in _lists(batch):
                b = np.unique(b[sim >= close])
                back = np.int64(bucket).tobytes()
                yield _batch(ASK, [(to, ids, back) for to, ids in by_bucket(bucket_of(b, buckets), b)])

    return run


def _reply(dim: int, k: int, close: float):
    def take(t: pa.Table) -> pa.Table:
        ids, v, copies = _points(t, dim)
        a, _, sim, _ = _edges(t)
        _, full = _state(ids, a, sim, k, close)
        rows = []
        for kind, asked, back in zip(t["kind"].to_pylist(), t["a"], t["b"]):
            if kind == ASK:
                at = np.searchsorted(ids, np.frombuffer(asked.as_buffer(), np.int64))
                rows.append((int(np.frombuffer(back.as_buffer(), np.int64)[0]), ids[at].tobytes(), v[at].tobytes(), copies[at].tobytes(), full[at].tobytes()))
        return _table(_batch(REPLY, rows))

    return take


def _verify(dim: int, k: int, close: float, threshold: float):
    """Edges of a bucket's lists that reach the threshold, with the copies at both ends and whether both are saturated."""

    def take(t: pa.Table) -> pa.Table:
        ids, v, copies = _points(t, dim)
        a, b, sim, _ = _edges(t)
        _, full = _state(ids, a, sim, k, close)
        near = sim >= close
        a, b = a[near], b[near]
        other = _cat(t, REPLY, "a", np.int64)
        order = np.argsort(other)
        x, y = np.searchsorted(ids, a), order[np.searchsorted(other[order], b)]
        w, more, dense = _cat(t, REPLY, "b", np.float32, dim), _cat(t, REPLY, "c", np.int64), _cat(t, REPLY, "d", np.bool_)
        sim = np.concatenate([np.einsum("ij,ij->i", v[x[i : i + 65536]].astype(np.float64), w[y[i : i + 65536]].astype(np.float64)) for i in range(0, len(x), 65536)] or [np.zeros(0)])
        ok = sim >= threshold
        a, b, x, y = a[ok], b[ok], x[ok], y[ok]
        swap = a > b
        return pa.table({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "at_a": np.where(swap, more[y], copies[x]), "at_b": np.where(swap, copies[x], more[y]), "dense": full[x] & dense[y]})

    return take


# ---- exact comparison of blocks -------------------------------------------------------------------------------


def _direct(threshold: float, dim: int, tie: bool):
    """Links between the two sides of each group (root, i, j), or within its only side: (id, n), and with tie rows
    (id, other) with null n that tie linked points together."""

    def take(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        root, i, j, side, ids, copies = (t[c].to_numpy() for c in ("root", "i", "j", "side", "id", "copies"))
        v = _units(t["v"], dim)
        order = np.lexsort((ids, side, j, i, root))
        cuts = np.append(np.flatnonzero(_firsts(root[order], i[order], j[order])), len(order))
        found = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = order[lo:hi]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            same = i[rows[0]] == j[rows[0]]
            if same:
                left = right = rows
            w = v[right]
            for at in range(0, len(left), 256):
                some = left[at : at + 256]
                sim = v[some] @ w.T
                linked = sim >= threshold
                x, y = np.nonzero(np.abs(sim - threshold) < 1e-4)
                if len(x):
                    linked[x, y] = np.einsum("ij,ij->i", v[some[x]].astype(np.float64), w[y].astype(np.float64)) >= threshold
                if same:
                    linked[np.arange(len(some)), np.arange(at, at + len(some))] = False
                found[some] += linked @ copies[right]
                if not same:
                    found[right] += copies[some] @ linked
                if tie and linked.any():
                    x, y = np.nonzero(linked)
                    label = forest(len(label), some[x], right[y], label)
        some = np.flatnonzero(found)
        out_id, out_n, out_other = ids[some], found[some], np.full(len(some), None)
        if tie:
            tied = np.flatnonzero(label != np.arange(len(label)))
            out_id, out_n, out_other = np.concatenate([out_id, ids[tied]]), np.concatenate([out_n.astype(object), np.full(len(tied), None)]), np.concatenate([out_other, ids[label[tied]].astype(object)])
        return pa.table({"id": pa.array(out_id, pa.int64()), "n": pa.array(list(out_n), pa.int64()), "other": pa.array(list(out_other), pa.int64())})

    return take


_FOUND = "id long, n long, other long"


def _everything(points: DataFrame, dim: int, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """All pairs of the table, compared exactly; every two blocks of points meet in a group of their own."""
    blocks = ceil(n / block)
    own = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = own.select(F.lit(0).cast("long").alias("root"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v", "copies")
    return sent.groupBy("i", "j").applyInArrow(_direct(threshold, dim, True), _FOUND)


# ---- saturated points of a class ------------------------------------------------------------------------------


def _assign(dim: int):
    """The nearest leader of each point, and the angle between them."""

    def take(t: pa.Table, leaders: pa.Table) -> pa.Table:
        names, w = leaders["cell"].to_numpy(), _units(leaders["lead"], dim)
        order = np.argsort(names)
        names, w = names[order], w[order]
        v = _units(t["v"], dim)
        at, angle = np.zeros(len(v), np.int64), np.zeros(len(v))
        for i in range(0, len(v), 1024):
            at[i : i + 1024] = (v[i : i + 1024] @ w.T).argmax(1)
            angle[i : i + 1024] = np.arccos(np.einsum("ij,ij->i", v[i : i + 1024].astype(np.float64), w[at[i : i + 1024]].astype(np.float64)).clip(-1, 1))
        return t.select(["root", "id", "v", "copies"]).append_column("cell", pa.array(names[at])).append_column("angle", pa.array(angle))

    return take


def _decide(threshold: float, dim: int):
    """For each cell of a class: how many vectors of other cells are certainly linked with all of its own, whether its
    own all are, and the cells (itself among them) that have to be compared."""
    most = acos(min(1.0, threshold))

    def take(t: pa.Table) -> pa.Table:
        order = np.argsort(t["cell"].to_numpy())
        t = t.take(pa.array(order)).combine_chunks()
        cell, radius, weight, v = t["cell"].to_numpy(), t["radius"].to_numpy(), t["weight"].to_numpy(), _units(t["lead"], dim).astype(np.float64)
        sure, own, rest = np.zeros(len(cell), np.int64), np.zeros(len(cell), bool), []
        for k in range(len(cell)):
            apart = np.arccos((v @ v[k]).clip(-1, 1))
            apart[k] = 0
            reach = radius + radius[k]
            all_, none = apart + reach <= most - DOUBT, apart - reach > most + DOUBT
            own[k] = all_[k]
            sure[k] = weight[all_].sum()
            rest.append(cell[k + np.flatnonzero(~(all_ | none)[k:])])
        return pa.table({"root": t["root"], "cell": cell, "members": t["members"], "sure": sure, "own": own, "rest": pa.array([x.tolist() for x in rest], pa.list_(pa.int64()))})

    return take


def _dense(members: DataFrame, dim: int, threshold: float, tables: Written, name: str, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """members: (root, id, v, copies). (id, n, other): links with other members of the same root, in parts to be summed."""
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    members = tables.put(f"{name}-members", members.join(sizes, "root"))
    few = members.where(F.col("m") <= cell)
    buckets = few.count() // 20_000 + 1
    zero = F.lit(0)
    few = few.select("root", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", "v", "copies", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"))
    found = few.groupBy("bucket").applyInArrow(_direct(threshold, dim, False), _FOUND)
    many = members.where(F.col("m") > cell)
    if many.isEmpty():
        return found
    # leaders by a hash, and the least id so that there is one
    chance = F.least(F.ceil(F.col("m") / cell), F.ceil(4 * F.sqrt("m"))) / F.col("m")
    leads = many.where((F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < chance * (1 << 30)) | (F.col("id") == F.col("least")))
    parts = F.ceil(F.col("m") / (1 << 16)).cast("int")
    salted = many.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), parts).cast("int"))
    copied = leads.select("root", F.col("id").alias("cell"), F.col("v").alias("lead"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    own = salted.groupBy("root", "salt").cogroup(copied.groupBy("root", "salt")).applyInArrow(_assign(dim), "root long, id long, v binary, copies long, cell long, angle double")
    own = tables.put(f"{name}-cells", own)
    cells = own.groupBy("root", "cell").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("members"))
    cells = cells.join(leads.select("root", F.col("id").alias("cell"), F.col("v").alias("lead")), ["root", "cell"])
    decided = tables.put(f"{name}-decided", cells.groupBy("root").applyInArrow(_decide(threshold, dim), "root long, cell long, members long, sure long, own boolean, rest array<long>"))
    certain = own.join(decided, ["root", "cell"]).select("id", (F.col("sure") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"), F.lit(None).cast("long").alias("other")).where("n > 0")
    # cells that have to be compared, in blocks
    parts = F.ceil(F.col("members") / block).cast("int")
    counts = decided.select("root", "cell", parts.alias("parts"))
    pairs = decided.select("root", F.col("cell").alias("c"), F.explode("rest").alias("d"))
    pairs = pairs.join(counts.toDF("root", "c", "cs"), ["root", "c"]).join(counts.toDF("root", "d", "ds"), ["root", "d"])
    pairs = pairs.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ds") - 1))).where("c <> d or x <= y")
    pairs = tables.put(f"{name}-pairs", pairs.select("root", "c", "d", "x", "y", F.xxhash64("c", "x").alias("i"), F.xxhash64("d", "y").alias("j")))
    held = own.join(counts, ["root", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")).select("root", "cell", "part", "id", "v", "copies")
    left = held.join(pairs.selectExpr("root", "c AS cell", "x AS part", "i", "j"), ["root", "cell", "part"]).withColumn("side", F.lit(0))
    right = held.join(pairs.where("c <> d or x <> y").selectExpr("root", "d AS cell", "y AS part", "i", "j"), ["root", "cell", "part"]).withColumn("side", F.lit(1))
    met = left.unionByName(right).groupBy("root", "i", "j").applyInArrow(_direct(threshold, dim, False), _FOUND)
    return found.union(certain).union(met)


# ---- the whole ------------------------------------------------------------------------------------------------


def near(table: DataFrame, threshold: float = THRESHOLD, k: int = K, cell: int = CELL) -> DataFrame:
    spark = table.sparkSession
    tables = Written(spark)
    rows, dim = valid(table, zero=False)
    units = tables.put("units", rows.mapInArrow(_unit(dim), "id long, v binary"))
    points = tables.put("points", units.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"))
    n = points.count()
    if n:
        roots, counts = _linked(points, dim, n, threshold, k, cell, tables)
        points = points.join(roots, "id", "left").join(counts, "id", "left")
    else:
        points = points.selectExpr("*", "id AS root", "0L AS n")
    named = points.select("v", F.coalesce("root", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    return units.join(named, "v").select(F.col("id").alias("vec_id"), "class_id", "links")


def _linked(points: DataFrame, dim: int, n: int, threshold: float, k: int, cell: int, tables: Written) -> tuple[DataFrame, DataFrame]:
    """((id, root), (id, n)): the classes of the points and their links with other points' vectors."""
    spark = points.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    vectors = tables.put("vectors", points.mapInArrow(_pack(buckets, dim), ROW))
    bits = min(40, max(1, round(log2(max(2, n / GUESS_SIZE)))))
    guesses, close = _guesses(bits, threshold), threshold - SLACK

    def exchange(df: DataFrame, take, returns: str = ROW) -> DataFrame:
        return df.groupBy("bucket").applyInArrow(take, returns)

    graph, made, audit = None, 0, Audit(points, dim, n, threshold, tables)
    for attempt in range(TRIES):
        # a (further) guess, then rounds until one finds no new pair above the threshold
        guess = exchange(vectors.mapInArrow(_guess(buckets, dim, bits, guesses, attempt), ROW), _meet(buckets, dim, attempt))
        found, first = guess if graph is None else guess.union(graph.mapInArrow(_old, ROW)), True
        while True:
            made += 1
            after = tables.put(f"graph{made}", exchange(found, _merge(k, close)))
            if graph is not None:
                tables.drop(f"graph{made - 1}")
            graph = after
            if not first and graph.mapInArrow(_fresh(k, close), "id long").isEmpty():
                break
            first = False
            everything = vectors.union(graph).union(graph.mapInArrow(_reverse(buckets, made), ROW))
            members = exchange(everything, _send(buckets, dim, k, close, made))
            found = exchange(members, _meet(buckets, dim, made)).union(graph.mapInArrow(_old, ROW))
        replies = exchange(vectors.union(graph).union(graph.mapInArrow(_ask(buckets, close), ROW)), _reply(dim, k, close))
        edges = exchange(vectors.union(graph).union(replies), _verify(dim, k, close, threshold), "a long, b long, at_a long, at_b long, dense boolean")
        edges = tables.put(f"edges{attempt}", edges.dropDuplicates(["a", "b"]))
        roots_at = f"roots{attempt}"
        roots = tables.put(roots_at, components(edges.select("a", "b"), tables, f"cc{attempt}"))
        dense = tables.put(f"dense{attempt}", graph.mapInArrow(_saturated(k, close), "id long"))
        links = edges.where("not dense").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("at_b").alias("n")), F.struct(F.col("b").alias("id"), F.col("at_a").alias("n")))).alias("x")).select("x.id", "x.n")
        if not dense.isEmpty():
            links = links.union(_dense(dense.join(roots, "id").join(points, "id").select("root", "id", "v", "copies"), dim, threshold, tables, f"class{attempt}", cell).select("id", "n"))
        counts = tables.put(f"counts{attempt}", links.groupBy("id").agg(F.sum("n").alias("n")))
        if audit.recall(counts, dense) >= TARGET:
            tables.keep("units", "points", roots_at, f"counts{attempt}")
            return roots, counts
        k *= 2
    found = tables.put("found", _everything(points, dim, n, threshold))
    return components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), tables, "all"), found.groupBy("id").agg(F.sum("n").alias("n")).where("n is not null")


class Audit:
    """The true links of a growing sample of the points, by brute force; they are counted once for all tries."""

    def __init__(self, points: DataFrame, dim: int, n: int, threshold: float, tables: Written):
        self.points, self.dim, self.threshold, self.tables = points, dim, threshold, tables
        self.parts, self.at, self.wanted = ceil(n / AUDIT), 0, []

    def recall(self, counts: DataFrame, dense: DataFrame) -> float:
        """The mean recall of the sampled points that have links, with saturated lists or without, whichever is less; 1 if
        none has any."""
        if not self.wanted:
            self._draw()
        while True:
            wanted = self.wanted[0]
            for more in self.wanted[1:]:
                wanted = wanted.union(more)
            hit = wanted.join(counts, "id", "left").select("id", F.least(F.coalesce("n", F.lit(0)) / F.col("all"), F.lit(1.0)).alias("share"))
            means = hit.join(dense.withColumn("inside", F.lit(True)), "id", "left").groupBy(F.coalesce("inside", F.lit(False)).alias("inside")).agg(F.count("*").alias("rows"), F.avg("share").alias("mean")).collect()  # two rows
            if self.at >= self.parts or sum(m["rows"] for m in means if not m["inside"]) >= ENOUGH:
                return min([1.0, *(m["mean"] for m in means)])
            self._draw()

    def _draw(self) -> None:
        step = min(AUDIT_MOST, max(1, self.at), self.parts - self.at)
        sample = self.points.where(F.pmod(F.xxhash64("id"), F.lit(self.parts)).between(self.at, self.at + step - 1)).select("id", "v").toArrow()  # about AUDIT * AUDIT_MOST rows at most
        links = self.points.mapInArrow(_true(sample, self.dim, self.threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("all"))
        self.wanted.append(self.tables.put(f"audit{self.at}", links))
        self.at += step


def _true(sample: pa.Table, dim: int, threshold: float):
    """(id, n): the links of each point of the sample with a part of the table."""
    ids, v = sample["id"].to_numpy(), _units(sample["v"], dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                linked = (_units(b.column("v"), dim) @ v.T) >= threshold + 1e-6
                linked &= b.column("id").to_numpy()[:, None] != ids
                n += b.column("copies").to_numpy() @ linked
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], names=["id", "n"])

    return run
