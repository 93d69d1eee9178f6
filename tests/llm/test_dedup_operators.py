"""SimHash, recompression, suffix array: against brute force, and odd rows."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from weftline.llm import recompress, repeats, simhash, suffixes
from weftline.llm.common import mix, table

from ..oracles import SMALL, compare
from .helpers import docs, empty_docs, odd_docs, prose

# ---- SimHash --------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = set(text.split())
    votes = [0] * simhash.BITS
    for w in words:
        name = np.array([xxhash.xxh3_64_intdigest(w)], np.uint64)
        for half in range(2):
            h = int(mix(name + np.uint64(half * 0x9E3779B9 + 1))[0])
            for b in range(64):
                votes[half * 64 + b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b, v in enumerate(votes) if v > 0) if words else None


def brute_groups(texts, radius):
    prints = {i: p for i, t in texts.items() if (p := plain_fingerprint(t or "")) is not None}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    groups = defaultdict(list)
    for i in ids:
        groups[top(i)].append(i)
    return {(i, g, i == g) for g, members in groups.items() if len(members) > 1 for i in members}


@pytest.mark.parametrize("radius, most", [(3, simhash.GROUP), (24, 8), (40, simhash.GROUP)])
def test_simhash_finds_exactly_the_groups(spark, radius, most):
    rng = random.Random(radius)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    for t in texts[:25]:
        words = t.split()
        for k in range(rng.randrange(1, max(2, len(words) // 5 + 1))):
            words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += texts[:5]
    got = {tuple(r) for r in simhash.groups(docs(spark, texts), radius, most=most).collect()}
    assert got == brute_groups(dict(enumerate(texts)), radius)


def test_simhash_whole_table(spark):
    frame = table(spark, SMALL, "documents")
    got = {tuple(r) for r in simhash.groups(frame).collect()}
    assert got == brute_groups({r["doc_id"]: r["text"] for r in frame.collect()}, simhash.RADIUS)


def test_long_documents_count_every_word():
    text = " ".join(f"w{k}" for k in range(70_000))
    both, _ = simhash.fingerprints_of(pa.array([text, "short text", text]))
    assert sum(int(x) << 64 * k for k, x in enumerate(both[0])) == plain_fingerprint(text)
    assert (both[0] == both[2]).all()


def test_allocation_is_best():
    rng = np.random.default_rng(3)
    costs = np.cumsum(rng.random((3, simhash._MOST + 1)), axis=1).tolist()
    got = simhash.allocate(costs, 5)
    assert sum(t + 1 for t in got) >= 6
    price = lambda ts: sum(c[t] for c, t in zip(costs, ts) if t >= 0)
    every = [(a, b, c) for a in range(-1, 7) for b in range(-1, 7) for c in range(-1, 7) if a + b + c + 3 >= 6]
    assert abs(price(got) - min(map(price, every))) < 1e-9


def bucket_labels(prints, radius, monkeypatch):
    """Components over all buckets of these distinct fingerprints; how many words of two were compared; how many pairs are
    candidates by the thresholds."""
    lo, hi = prints[:, 0].view(np.int64), prints[:, 1].view(np.int64)
    arranged = simhash.arranged(lo, hi, np.arange(simhash.BITS))
    values = simhash._values(arranged)
    counts = np.array([np.bincount(values[:, g], minlength=1 << simhash.WIDTH) for g in range(simhash.PARTS)])
    costs = [simhash.estimate(c) for c in counts]
    thresholds = simhash.allocate(costs, radius)
    compared, real = [0], np.bitwise_count

    def counting(x):
        compared[0] += np.size(x)
        return real(x)

    units = simhash._units(thresholds, counts, simhash.GROUP)
    probe = simhash._probe(units, thresholds, radius)
    monkeypatch.setattr(simhash.np, "bitwise_count", counting)
    label = np.arange(len(prints))
    for u, unit in enumerate(units):
        key = unit.keys(values[:, unit.g])
        for k in np.unique(key):
            rows = np.flatnonzero(key == k)
            points = np.column_stack([rows, arranged[rows].view(np.int64)]).tobytes()
            edges = probe(pa.table({"unit": pa.array([u], pa.int32()), "points": pa.array([points], pa.binary())}))
            label = simhash.forest(len(prints), edges["a"].to_numpy(), edges["b"].to_numpy(), label)
    monkeypatch.setattr(simhash.np, "bitwise_count", real)
    return label, compared[0], sum(c[t] for c, t in zip(costs, thresholds) if t >= 0)


def clustered(rng, n, centres, flips):
    prints = rng.integers(0, 1 << 63, (centres, 2)).astype(np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        prints[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(prints, axis=0)


@pytest.mark.parametrize("block, many", [(64, 1), (1 << 16, 1), (64, 1 << 40), (1 << 16, 1 << 12)])
@pytest.mark.parametrize("radius", [5, 24, 40])
def test_blocks_and_single_pairs_find_the_same(block, many, radius, monkeypatch):
    prints = clustered(np.random.default_rng(radius), 700, 60, 15)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "MANY", many)
    label, _, _ = bucket_labels(prints, radius, monkeypatch)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints).sum(2) <= radius)
    assert (label == simhash.forest(len(prints), a, b, np.arange(len(prints)))).all()


def test_candidates_are_compared_once_and_mostly_by_one_word(monkeypatch):
    prints = clustered(np.random.default_rng(1), 30_000, 30_000, 0)
    _, compared, candidates = bucket_labels(prints, simhash.RADIUS, monkeypatch)
    assert compared < 1.2 * candidates


def test_a_dense_cluster_is_no_square(monkeypatch):
    prints = clustered(np.random.default_rng(2), 20_000, 1, 11)
    label, compared, candidates = bucket_labels(prints, simhash.RADIUS, monkeypatch)
    assert (label == 0).all() and compared < candidates / 10


def test_each_mask_is_looked_for_by_one_unit():
    for t in range(simhash._MOST + 1):
        units = simhash._units([t], np.zeros((1, 1 << simhash.WIDTH), np.int64), simhash.GROUP)
        got = np.sort(np.concatenate([simhash.reach_of(u) for u in units]))
        assert (got == np.sort(simhash.masks(tuple(range(simhash.WIDTH)), t))).all()


def test_simhash_odd_rows(spark):
    odd = odd_docs(spark)
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in simhash.groups(odd).collect()}
    assert got == {5: (5, True), 6: (5, False)}  # of the two rows of 7 that without a text counts
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "4", "5", "7", "8", "9", "None", "None"]
    assert simhash.groups(empty_docs(spark)).count() == 0 and simhash.keep_one(empty_docs(spark)).count() == 0


# ---- repeated passages ----------------------------------------------------------------------------------------


def brute_spans(texts, least):
    places = defaultdict(list)
    for i in sorted(texts):
        words = (texts[i] or "").split()
        for s in range(len(words) - least + 1):
            places[tuple(words[s : s + least])].append((i, s))
    marks = defaultdict(list)
    for found in places.values():
        for k, (i, s) in enumerate(sorted(found)):
            if len(found) > 1:
                marks[i, k > 0].append(s)
    out = set()
    for (i, copy), starts in marks.items():
        begin = last = None
        for s in sorted(starts):
            if begin is not None and s > last + least:
                out.add((i, begin, last + least, copy))
                begin = None
            begin = s if begin is None else begin
            last = s
        out.add((i, begin, last + least, copy))
    return out


def planted(rng):
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(25)]
    for _ in range(12):
        passage = prose(rng, rng.choice([49, 50, 51, 60, 150]))
        for _ in range(rng.randrange(2, 5)):
            k = rng.randrange(len(texts))
            words = texts[k].split()
            at = rng.randrange(len(words) + 1)
            texts[k] = " ".join(words[:at] + passage.split() + words[at:])
    return [*texts, "same " * 180, "a b " * 90, texts[0], "x " + "a b " * 60]


@pytest.mark.parametrize("operator", [recompress, suffixes])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_are_those_of_brute_force(spark, operator, seed):
    texts = planted(random.Random(seed))
    got = {tuple(r) for r in operator.find(docs(spark, texts)).collect()}
    assert got == brute_spans(dict(enumerate(texts)), repeats.LEAST)


@pytest.mark.parametrize("hot", [1, 40])
def test_hot_suffixes_are_compared_across_parts(spark, hot):
    texts = planted(random.Random(4)) * 2
    got = {tuple(r) for r in suffixes.find(docs(spark, texts), hot_rows=hot).collect()}
    assert got == brute_spans(dict(enumerate(texts)), repeats.LEAST)


@pytest.mark.parametrize("operator", [recompress, suffixes])
def test_passages_whatever_the_parts_and_buckets(spark, operator, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 2000)
    monkeypatch.setattr(repeats, "PART", 5000)
    monkeypatch.setattr(suffixes, "PART", 20_000)
    monkeypatch.setattr(suffixes, "SORTED", 5000)
    rng = random.Random(6)
    texts = planted(rng)
    ids = rng.sample([*range(-3, 40), *(rng.randrange(-(2**63), 2**63) for _ in range(20))], len(texts))
    got = {tuple(r) for r in operator.find(docs(spark, texts, ids)).collect()}
    assert got == brute_spans(dict(zip(ids, texts)), repeats.LEAST)


@pytest.mark.parametrize("operator", [recompress, suffixes])
def test_passages_are_those_of_sql(spark, operator):
    compare(spark, lambda s, d: operator.find(table(s, d, "documents")), repeats.SQL.format(least=repeats.LEAST))


@pytest.mark.parametrize("operator", [recompress, suffixes])
def test_passages_odd_rows(spark, operator):
    odd = odd_docs(spark)
    got = {tuple(r) for r in operator.find(odd).collect()}
    assert got == {(5, 0, 120, False), (6, 0, 120, True)}
    cut = operator.drop_copies(odd)
    assert cut.columns == odd.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] is not None}
    assert sorted(left) == [1, 2, 3, 4, 5, 7, 8, 9] and left[5].startswith("w0 ") and left[1] is None and left[2] == ""
    assert cut.where("doc_id is null").count() == 2
    assert operator.find(empty_docs(spark)).count() == 0 and operator.drop_copies(empty_docs(spark)).count() == 0


def test_remaining():
    cut = lambda s, *runs: repeats.remaining(s, [{"start": a, "end": b} for a, b in runs])
    assert cut("a  b\tc d", (1, 2)) == "a\tc d"
    assert cut("a b c", (0, 2)) == "c"
    assert cut("a b c", (0, 3)) == ""
    assert cut("a b c d e", (1, 2), (3, 5)) == "a c"


def test_multikey_quicksort():
    words = np.random.default_rng(0).integers(1, 4, (500, 12)).astype(np.uint32)
    order = suffixes.multikey(words)
    assert [tuple(x) for x in words[order]] == sorted(map(tuple, words))
