"""The pipeline: against a version by brute force, odd rows through every stage, and what is registered."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from weftline.llm import packing, pii, quality, queries, repeats, simhash
from weftline.llm.common import table

from ..oracles import SMALL
from .helpers import empty_docs, odd_docs, text_lengths
from .test_dedup_operators import brute_groups, brute_spans


def test_registered():
    names = list(queries.QUERIES)
    assert [re.match(r"op(\d+)_", n).group(1) for n in names] == [str(k) for k in range(1, 11)]
    assert list(corpus_pipeline.QUERIES) == ["pipeline"] and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "substring", "pii", "packing"]


def test_pipeline_is_that_of_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect() if r["doc_id"] in docs}
    known = sorted(labels)
    y = np.array([labels[i] for i in known])
    ids = sorted(docs)
    if min((y == 0).sum(), (y == 1).sum()) >= len(quality.NAMES) + 2:
        model = quality.Model(quality.statistics(pa.array([docs[i] for i in known])), y)
        score = model.score(quality.statistics(pa.array([docs[i] for i in ids])))
        docs = {i: docs[i] for i, s in zip(ids, score) if s >= quality.THRESHOLD}
    gone = {i for i, _, kept in brute_groups(docs, simhash.RADIUS) if not kept}
    docs = {i: t for i, t in docs.items() if i not in gone}
    words = {i: t.split() for i, t in docs.items()}
    for i, start, end, copy in brute_spans(docs, repeats.LEAST):
        if copy:
            words[i][start:end] = [None] * (end - start)
    texts = {i: pii.Pseudonyms(pii.DEMO_KEY).text(docs[i]).split() if None not in w else [x for x in w if x is not None] for i, w in words.items()}
    sizes = {i: len(w) for i, w in texts.items() if w}

    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == sizes
    left = Counter(min(packing.CAPACITY, n - k) for n in sizes.values() for k in range(0, n, packing.CAPACITY))
    assert len({r["window_id"] for r in rows}) == sum(times for times, _ in packing.plan(left, packing.CAPACITY))
    assert len(rows) == sum(left.values())


def test_decisions_take_effect(spark):
    """Each stage's output, read as the next one's input, has nothing left for the same stage to do."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    n = docs.count()
    one = simhash.keep_one(docs).cache()
    assert one.columns == docs.columns and n > one.count()
    assert {r["doc_id"] for r in simhash.groups(docs).where("kept").collect()} <= {r["doc_id"] for r in one.select("doc_id").collect()}
    cut = corpus_pipeline.substring_stage(spark, one, "")
    assert cut.columns == docs.columns
    assert cut.where("n_chars <> length(text)").isEmpty()
    new = corpus_pipeline.pii_stage(spark, docs, "")
    assert new.columns == docs.columns and new.count() == n
    one.unpersist()


def test_odd_rows_pass_every_stage(spark):
    for make in (odd_docs, empty_docs, lambda s: text_lengths(odd_docs(s))):
        docs = make(spark)
        columns, kind = docs.columns, docs.schema["n_chars"].dataType
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            if k < 4:
                docs = docs.cache()
                assert docs.columns == columns and docs.schema["n_chars"].dataType == kind
                assert kind.typeName() != "string" or docs.where("n_chars <> 'x'").isEmpty()
        assert docs.columns == ["window_id", "doc_id", "piece", "start", "length", "at"]
        docs.collect()
