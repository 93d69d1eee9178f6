"""Pages and addresses from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html(spark: SparkSession, *paths: str) -> DataFrame:
    """(url, html): each file is a page, and its path the address."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    """(url, content): files as they are."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("url"), "content")


def read_urls(spark: SparkSession, *paths: str) -> DataFrame:
    """(url): a line each; blank lines don't count."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("url")).where("url <> ''")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select("url", "html")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
