"""Crawling a stream of addresses: stream-static joins, and a seen-set as the state of a streaming deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import udfs
from ..operators import pages
from ..operators.fetch import DEFAULT, fetch
from ..options import CrawlOptions
from ..plans.lineage import shared_dir


def discover_children(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT, ttl: str | None = None) -> DataFrame:
    """(url): each child page once for the whole stream. With ttl, urls has an event time `ts`, and an address may come
    again after that long, which bounds the state."""
    time = ["ts"] if ttl else []
    parents = urls.select(udfs.once(udfs.normalize_url("url")).alias("url"), *time).where("url <> ''")
    parents = parents.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["url"]) if ttl else parents.dropDuplicates(["url"])
    found = pages.child_links(fetch(parents, snapshot, options).select("url", "html", *time))
    out = found.select(udfs.once(udfs.normalize_social("link")).alias("url"), *time).where("url <> ''")
    return out.dropDuplicatesWithinWatermark(["url"]) if ttl else out.dropDuplicates(["url"])


def fetch_stream(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    return fetch(urls.select("url"), snapshot, options).select("url", "html")


def children_stream(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    return fetch_stream(discover_children(urls, snapshot, options), snapshot, options)


def read_urls(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive; so many files a batch. The path is a folder or a pattern
    (a single file has to be given as a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream until its source has no more, and returns what it wrote to the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
