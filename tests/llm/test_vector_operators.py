"""Top-k search and NN-descent: against brute force, and odd rows."""

import duckdb
import numpy as np
import pytest

from weftline.llm import descent, topk
from weftline.llm.common import table
from weftline.llm.components import forest

from ..oracles import SMALL, compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) if x is not None else None for x in v], 0) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def odd(spark):
    return spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (3, [0.0, 1.0], 0), (3, [0.5, 1.0], 0), (4, None, 0), (5, [1.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [0.0, 0.0], 0), (9, [], 0), (None, [1.0, 1.0], 0)],
        SCHEMA,
    ).selectExpr("*", "1 AS id", "2 AS v", "3 AS block", "4 AS root", "5 AS a")


def clustered(n, dim, seed=0, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, dim))
    return np.concatenate([centres[rng.integers(0, len(centres), n - 60)] + spread * rng.standard_normal((n - 60, dim)), np.tile(centres[:1], (60, 1)) + 0.05 * rng.standard_normal((60, dim))])


@pytest.mark.parametrize("broadcast, segment", [(topk.BROADCAST, topk.SEGMENT), (topk.BROADCAST, 40), (0, 10)])
def test_topk_is_exact(spark, broadcast, segment, monkeypatch):
    monkeypatch.setattr(topk, "MERGE", 4)
    v = np.round(clustered(400, 8), 1)  # rounding makes ties
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in topk.search(frame(spark, v), k=5, every=1, broadcast=broadcast, segment=segment).collect()}
    v = v.astype(np.float32).astype(np.float64)
    assert len(got) == 5 * len(v)
    for i in range(len(v)):
        d = ((v[i] - v) ** 2).sum(1)
        best = [j for j in np.lexsort((np.arange(len(v)), d)) if j != i][:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, round(float(np.sqrt(d[j])), 6)) for j in best]


@pytest.mark.parametrize("every", [1, topk.EVERY])
def test_topk_is_that_of_sql(spark, every):
    compare(spark, lambda s, d: topk.search(table(s, d, "embeddings"), every=every), topk.SQL.format(k=topk.K, every=every))


def test_topk_cutoff_saves_totals_and_segments(spark):
    v = np.concatenate([10 * c + 0.5 * np.random.default_rng(3).standard_normal((100, 16)) for c in np.random.default_rng(4).standard_normal((20, 16))])
    found, segments = topk._sufficient(frame(spark, v), 5, 1, 2, topk.BROADCAST, 100)
    rows = found.collect()
    assert sum(r["totals"] for r in rows) < 0.1 * len(v) ** 2
    assert len(rows) < 0.5 * segments * len({r["q"] for r in rows})


def test_topk_of_equal_vectors(spark):
    rows = topk.search(frame(spark, [[1.0, 2.0]] * 500), k=3, every=100, segment=50).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == [(q, r + 1, i) for q in range(0, 500, 100) for r, i in enumerate([i for i in range(4) if i != q][:3])]


def test_topk_odd_rows(spark):
    rows = topk.search(odd(spark), k=10, every=1).collect()
    assert {r["query_id"] for r in rows} == {1, 2, 3, 8}  # of the two rows of 3 the smaller vector
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 1] == [2, 8, 3]
    assert topk.search(frame(spark, [])).count() == 0
    assert topk.search(frame(spark, [[1.0, 2.0]])).count() == 0 and topk.search(frame(spark, [[1.0], [2.0]], [1, 2])).count() == 0


def brute_links(v, threshold):
    """(links, class) of each vector."""
    v = np.asarray(v).astype(np.float32).astype(np.float64)
    v = v / np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    x, y = np.nonzero(near)
    return near.sum(1), forest(len(v), x, y, np.arange(len(v)))


def found(frame):
    rows = sorted(frame.collect(), key=lambda r: r["vec_id"])
    return [r["vec_id"] for r in rows], np.array([r["links"] for r in rows]), np.array([r["class_id"] for r in rows])


@pytest.mark.parametrize("seed", [0])
def test_descent_recall_and_precision(spark, seed):
    v = clustered(600, 32, seed)
    ids, links, classes = found(descent.near(frame(spark, v), threshold=0.9))
    want, roots = brute_links(v, 0.9)
    assert ids == list(range(len(v))) and (links <= want).all() and want.sum() > 1000
    some = want > 0
    assert (links[some] / want[some]).mean() >= descent.TARGET
    assert (roots[classes] == roots).all()  # no class holds what isn't linked
    if (links == want).all():
        assert (classes == roots).all()


def test_descent_odd_rows(spark):
    assert sorted(tuple(r) for r in descent.near(odd(spark)).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert descent.near(frame(spark, [])).count() == 0
    assert [tuple(r) for r in descent.near(frame(spark, [[1.0, 0.0]])).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("n", [5000])
def test_descent_equal_vectors(spark, n):
    rng = np.random.default_rng(0)
    v = [[1.0, 2.0, 3.0, 4.0]] * n + [[-2.0, -4.0, -6.0, -8.0]] * 3 + rng.standard_normal((50, 4)).tolist()
    ids, links, classes = found(descent.near(frame(spark, v)))
    want, roots = brute_links(v, descent.THRESHOLD)
    assert (links == want).all() and (classes == roots).all() and links[0] >= n - 1


@pytest.mark.parametrize("spread, cell", [(0.01, 64), (0.3, 32)])
def test_descent_of_a_hot_group(spark, spread, cell):
    """Near-copies of one vector, tight (cells are decided as a whole) and loose (cells are compared)."""
    rng = np.random.default_rng(1)
    v = np.concatenate([np.ones(16) + spread * rng.standard_normal((1200, 16)), rng.standard_normal((200, 16))])
    _, links, classes = found(descent.near(frame(spark, v), cell=cell))
    want, roots = brute_links(v, descent.THRESHOLD)
    some = want > 0
    assert (links <= want).all() and (links[some] / want[some]).mean() >= descent.TARGET and want.max() > 500
    if spread < 0.1:
        assert (links == want).all() and (classes == roots).all()


@pytest.mark.parametrize("spread", [0.02, 0.25, 0.5])
def test_cells_count_what_brute_force_does(spark, spread):
    rng = np.random.default_rng(2)
    v = np.concatenate([c + spread * rng.standard_normal((300, 8)) for c in rng.standard_normal((3, 8))])
    copies = rng.integers(1, 4, len(v))
    unit = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    members = spark.createDataFrame([(0, i, x.tobytes(), int(c)) for i, (x, c) in enumerate(zip(unit, copies))], "root long, id long, v binary, copies long")
    got = {r["id"]: r["n"] for r in descent._dense(members, 8, 0.95, descent.Written(spark), "t", cell=16, block=20).groupBy("id").sum("n").toDF("id", "n").collect()}
    near = unit.astype(np.float64) @ unit.T.astype(np.float64) >= 0.95
    np.fill_diagonal(near, False)
    assert got == {i: n for i, n in enumerate((near @ copies).tolist()) if n}


def test_descent_is_that_of_sql(spark):
    v = clustered(300, 16)
    pandas = frame(spark, v).toPandas()
    con = duckdb.connect()
    con.register("embeddings", pandas)
    want = con.execute(descent.SQL.format(threshold=0.9)).fetchall()
    got = {tuple(r) for r in descent.near(frame(spark, v), threshold=0.9).collect()}
    assert got == set(want) and len({c for _, c, _ in got}) < 280


def test_descent_sql_on_the_tables(spark):
    compare(spark, lambda s, d: descent.near(table(s, d, "embeddings")), descent.SQL.format(threshold=descent.THRESHOLD))


def hot_and_pairs(n, dim=64, seed=0):
    """A hot group of near-equal vectors, then n / 100 vectors each with one neighbour, then those neighbours, then others."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    hot, pairs = n * 3 // 100, n // 100
    v[:hot] = v[0] + 0.001 * rng.standard_normal((hot, dim))
    for i in range(hot, hot + pairs):
        cosine, other = rng.uniform(0.951, 0.985), rng.standard_normal(dim)
        other -= other @ v[i] * v[i]
        v[i + pairs] = cosine * v[i] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    return v, hot, pairs


def test_descent_is_exact_where_the_graph_finds_nothing(spark, monkeypatch):
    def nothing(*_):
        def run(batches):
            for _ in batches:
                pass
            yield from ()

        return run

    monkeypatch.setattr(descent, "_guess", nothing)
    v = clustered(300, 32)
    _, links, classes = found(descent.near(frame(spark, v), threshold=0.9))
    want, roots = brute_links(v, 0.9)
    assert (links == want).all() and (classes == roots).all() and want.sum() > 400


def test_descent_audit_counts_rows(spark):
    v, hot, pairs = hot_and_pairs(2000)
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    points = spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(v)], "id long, v binary, copies long")
    audit = descent.Audit(points, 64, len(v), 0.95, descent.Written(spark))
    dense = spark.range(hot)
    links = dense.selectExpr("id", f"{hot - 1}L AS n")
    assert audit.recall(links, dense) == 0  # 1,770 of 1,790 pairs are found, but none of 40 of the 100 vectors
    assert audit.recall(links.union(spark.range(hot, hot + 2 * pairs).selectExpr("id", "1L")), dense) == 1
