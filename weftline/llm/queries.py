"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, descent, packing, pii, quality, recompress, repeats, simhash, suffixes, token_ids, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encode_table(table(spark, sf_dir, "documents"))[0]


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.find(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_ids, op2_simhash, op3_recompression, op4_topk, op5_suffix_array, op6_pii, op7_quality, op8_bpe, op9_nn_descent, op10_packing)}
ORACLES: dict[str, str] = {
    "op3_recompression": repeats.SQL.format(least=repeats.LEAST),
    "op4_topk": topk.SQL.format(k=topk.K, every=topk.EVERY),
    "op9_nn_descent": descent.SQL.format(threshold=descent.THRESHOLD),
    "op5_suffix_array": repeats.SQL.format(least=repeats.LEAST),
}
