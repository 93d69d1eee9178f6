"""The training-data pipeline: five operators of weftline.llm over the documents, one after the other.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. Every stage works on all that its predecessor kept:

* quality: documents that the classifier, fitted on `labels` beside the documents, rejects go.
* simhash: of each group of near-copies the document with the smallest id stays.
* substring: words of passages that stand elsewhere before (by id and place) are cut out, and documents of which
  nothing remains go.
* pii: personal values become pseudonyms.
* packing: the windows of a training run, as (window_id, doc_id, piece, start, length, at).

All but the last return the columns of documents. Edge cases: rows with a null id or text pass all stages but packing,
which has no place for them; of rows that repeat an id one passes simhash; an empty table gives an empty result; further
columns pass through unchanged to packing, which doesn't read them. SQL can't express the stages (a fit, keyed
permutations, a packing heuristic), so there is none; the tests hold the result against a version by brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import packing, pii, quality, recompress, simhash
from weftline.llm.common import remove, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recompress.drop_copies(docs, length="n_chars")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, length="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("substring", substring_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, which lie in the shared folder; what the stages before returned goes once it was read."""
    out = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{root}/{k}-{name}")
        out = spark.read.parquet(f"{root}/{k}-{name}")
        if k:
            remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return out


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
